"""Periodic runs, fingerprints and conversation repair against plain versions."""

import collections
import random

import plain
import pytest
from conftest import DATA

from tickloom.llm import common, conversations, fingerprints, queries, runs

Q = queries.queries()


@pytest.fixture(scope="module")
def rows(spark):
    return sorted((r.doc_id, r.text) for r in common.documents(spark, DATA).select("doc_id", "text").collect())


def periodic(rng, parts):
    """Words of random stretches, some periodic, some of one word."""
    out = []
    for _ in range(rng.randint(1, parts)):
        letters = "ab" if rng.random() < 0.4 else "abcdefghijk"
        p = [rng.choice(letters) for _ in range(rng.randint(1, 40))]
        out += (p * rng.randint(1, 9))[: rng.randint(10, 200)] if rng.random() < 0.7 else ["a"] * rng.randint(1, 90)
    return out


def test_runs_query(spark, rows):
    got = {r.doc_id: tuple(r)[1:] for r in Q["op11_periodic_runs"](spark, DATA).collect()}
    assert got == {i: plain.run_row(plain.planted(i, t)) for i, t in rows}
    assert sum(r[0] > 0 for r in got.values()) > len(rows) // 20


@pytest.mark.parametrize("least, times", [(24, 3), (6, 2), (40, 5)])
def test_runs(spark, least, times):
    """Random periodic texts, other bounds, runs at a text's ends and across masked words, and hard rows."""
    rng = random.Random(least)
    texts = [None, "", " \t", "a", "x " * 5000, "　 \x1c " * 40, *[" ".join(periodic(rng, 5)) for _ in range(300)]]
    df = spark.createDataFrame([(None if n % 50 == 7 else n % 90, t, "clash") for n, t in enumerate(texts)], "doc_id long, text string, runs string")
    got = collections.Counter((r.doc_id, tuple(map(tuple, r.runs)), r.collapsed) for r in runs.periodic_runs(df, least, times).collect())
    want = collections.Counter()
    for n, t in enumerate(texts):
        w = [x.decode() for x in (t or "").encode().split()]
        found = plain.periods(w, least, times)
        want[None if n % 50 == 7 else n % 90, tuple(found), plain.collapsed(w, found)] += 1
    assert got == want


def test_overlap():
    """k follows from the least overlap, and every word of a run survives the mask."""
    assert runs.overlap(24, 3) == 16 and runs.overlap(6, 2) == 3
    import numpy as np

    rng = random.Random(5)
    for _ in range(50):
        w = periodic(rng, 4)
        ids = np.array([ord(x) for x in w])
        spans = list(zip(*runs.surviving(ids, 16)))
        assert all(any(a <= start and start + length <= b for a, b in spans) for start, length, _ in plain.periods(w))


def test_fingerprints_query(spark, rows):
    got = {r.doc_id: r for r in Q["op12_fingerprints"](spark, DATA).collect()}
    assert len(got) == len(rows)
    texts = [t or "" for _, t in rows]
    better = 0
    for n, (i, _) in enumerate(rows):
        text, after = texts[n], texts[(n + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), plain.sha(edited))
        a, b, c = (fingerprints.fingerprint(x) for x in (text, edited, after))
        assert (r.fingerprint, r.edited_fingerprint) == (a, b)
        share = lambda x, y: max(0.0, (sum(map(str.__eq__, x, y)) / 256 - 1 / 16) / (15 / 16))
        assert r.near_edited == pytest.approx(share(a, b)) and r.near_next == pytest.approx(share(a, c))
        better += r.near_edited > r.near_next + 0.2 or len(text) < 40 or text == after
    assert better >= 0.98 * len(rows)


def test_walk(rows):
    """The walk side by side and alone, cut into slices or not, is the walk step by step."""
    rng = random.Random(3)
    texts = ["", "a", "ab", "abc", "abcd", "abcdefg", "é日本\U0001f600", *[(t or "")[: rng.randrange(200)] for _, t in rows[:40]], "lorem ipsum " * 900, ""]
    args = (fingerprints._moves(), fingerprints._classes(), fingerprints._records(), fingerprints.SLOTS, fingerprints.PERIOD)
    for text, digits in zip(texts, fingerprints.prints(texts)):
        assert digits.tolist() == plain.walk_digits(text, *args) == fingerprints.prints([text])[0].tolist()
        assert fingerprints.digits(fingerprints.fingerprint(text)).tolist() == digits.tolist()


def test_edits_edges(spark):
    """Nulls, repeated ids and rows, a single row, and an empty table; every row follows on one other."""
    rows = [(None, "null id"), (None, None), (1, "same"), (1, "same"), (2, ""), (3, "x" * 3000), (4, None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, part string")
    got = fingerprints.with_edits(df).collect()
    assert collections.Counter((r.doc_id, r.n_chars) for r in got) == collections.Counter((i, len(t or "")) for i, t in rows)
    assert len({r.fingerprint for r in got if r.doc_id == 1}) == 1
    one = fingerprints.with_edits(df.filter("doc_id = 3")).collect()
    assert len(one) == 1 and one[0].near_next == 1 and one[0].near_edited == 1 and one[0].edited_fingerprint == one[0].fingerprint
    assert fingerprints.with_edits(df.limit(0)).collect() == []


def test_search(spark, rows):
    """Recall of banding with verification against all pairs of fingerprints, with edited copies and equal texts."""
    rng = random.Random(9)
    base = [t for _, t in rows if t and len(t) > 400][:40]
    table = [(n, t) for n, t in enumerate(base)]
    for n, t in enumerate(base):
        cut = list(t)
        for _ in range(len(t) // 100):
            cut[rng.randrange(len(cut))] = "#"
        table += [(1000 + n, "".join(cut)), (2000 + n, t)]
    docs = spark.createDataFrame([*table, (None, base[0]), (5000, None), (5001, "")], "doc_id long, text string")
    got = {(r.query_id, r.doc_id) for r in fingerprints.search(docs, docs.filter("doc_id % 20 = 0")).collect()}
    digits = {i: fingerprints.prints([t])[0] for i, t in [*table, (5000, ""), (5001, "")]}
    want = {(a, b) for a in digits if a % 20 == 0 for b in digits if a != b and fingerprints.likeness(digits[a], digits[b]) >= 0.8}
    assert got == want and {(0, 2000), (20, 1020), (5000, 5001)} <= got


def talk(rng, conv, n):
    """n turns, odd roles, blanks, copies and cut ends among them."""
    texts = ["Yes.", "No!", "why?", "cut off", " ", "", "ok", "dots...", "　"]
    return [(conv, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), rng.choice(texts) if rng.random() < 0.5 else f"{rng.random()}{rng.choice('.x')}") for t in range(n)]


def test_conversations_query(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in Q["op13_conversation_repair"](spark, DATA).collect()}
    assert got == plain.repairs(table)


def test_conversations(spark, monkeypatch):
    """Random conversations, searched whole and in pieces of a few turns, and turns without numbers or rows."""
    rng = random.Random(11)
    table = [r for c in range(120) for r in talk(rng, c, rng.randint(1, 14))]
    table += talk(rng, 500, 90) + talk(rng, 501, 70) + [(None, None, None, None), (900, None, "user", "Hi."), (901, 7, None, "Hi."), (901, -2, "assistant", None)]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    want = plain.repairs(table)
    whole = {r.conv_id: tuple(r)[1:] for r in conversations.repair(conversations.damaged(df)).collect()}
    assert whole == want
    monkeypatch.setattr(conversations, "LONG", 8)
    monkeypatch.setattr(conversations, "PIECE", 5)
    pieces = {r.conv_id: tuple(r)[1:] for r in conversations.repair(conversations.damaged(df)).collect()}
    assert pieces == want
    back = collections.defaultdict(list)
    for r in conversations.repaired(conversations.damaged(df)).orderBy("conv_id", "place").collect():
        back[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: plain.sha("\n".join(back[c])) for c in want} == {c: v[-1] for c, v in want.items()}
    import re

    assert all(re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines)) for lines in back.values())


def test_insert_never_cheapest():
    """The search weighs insertions; none is ever in a cheapest repair, as the pieces rely on."""
    rng = random.Random(2)
    for _ in range(500):
        turns = [(rng.choice("usat"), rng.random() < 0.3, rng.random() < 0.4) for _ in range(rng.randint(1, 9))]
        ((cost, audit),) = conversations._search(turns, 0, conversations.ACCEPT, True).values()
        assert (cost, audit) == plain.cheapest([(r, "", gone, cut) for r, gone, cut in turns])[:2] and "I" not in audit


def test_undamaged(spark):
    """Without damage: rows as they are, ties by role and text, equal rows, an empty table."""
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 0, "assistant", "Yo."), (1, 1, "user", "A?"), (1, 1, "user", "A?"), (1, 2, "assistant", "B.")], "conv_id long, turn long, role string, text string")
    (r,) = conversations.repair(df).collect()
    assert (r.gaps, r.blank, r.duplicate, r.truncated, r.cost) == (0, 0, 1, 0, 4) and r.audit == "RRKDK"
    assert conversations.repair(df.limit(0)).collect() == [] and conversations.repaired(df.limit(0)).collect() == []


def test_bpe_marks_and_unknown_ids():
    """Words with marks after them are cut as the library cuts them; an id outside the vocabulary raises, also a negative one; long runs of ids are decoded in slices."""
    import pytest
    from tokenizers import Tokenizer

    from tickloom.llm import bpe

    codec, lib = bpe.Codec(open(bpe.default_vocabulary()).read()), Tokenizer.from_file(bpe.default_vocabulary())
    texts = ["a word, and. more! marks; so: what? it's don't x,, ,x .", " , . a", "Été, naïve. ßü! 日本, ab1, a_b. a b, c.", "x,\ny.\n\nz! ", "tail,", ",", "word's, we'll."]
    for text, ids in zip(texts, codec.encode_batch(texts)):
        assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids
        assert codec.decode(ids) == codec.decode(ids.tolist()) == text
    for bad in ([-1], [10**7]):
        with pytest.raises(KeyError):
            codec.decode(bad)
    assert codec.decode([]) == ""
    assert isinstance(codec.starts, bpe.np.ndarray) and codec.decode([codec.vocab[b"a"]] * (2 * bpe.SLICE + 1)) == "a" * (2 * bpe.SLICE + 1)
