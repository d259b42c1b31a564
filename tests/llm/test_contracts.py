"""Every query's own columns against a plain-Python version, over all documents of the small tables."""

import collections
import zlib

import plain
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tickloom.llm import common, mixing, queries, sharding
from tickloom.llm.ranking import unit

Q = queries.queries()


@pytest.fixture(scope="module")
def docs(spark):
    return common.documents(spark, DATA)


@pytest.fixture(scope="module")
def rows(docs):
    return sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


def test_secrets(spark, rows):
    got = {r.doc_id: r for r in Q["op2_secret_scan"](spark, DATA).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        base = plain.secret_spans(t)
        assert got[i].base_sha256 == plain.sha(",".join(base))
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex"))
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("field")] == base


def test_pii(spark, rows):
    got = {r.doc_id: r for r in Q["op4_pii"](spark, DATA).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        base = plain.pii_spans(t)
        assert got[i].base_sha256 == plain.sha(",".join(base))
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(s.startswith(k) for s in base) for k in ("email", "ip", "card", "phone"))
        spans = [s for s in got[i].spans.split(",") if s]
        assert [s for s in spans if s.split(":")[0] in ("email", "ip", "card", "phone")] == base
        scores = [float(x) for x in got[i].scores.split(",") if x]
        assert len(scores) == len(spans) and all(0 < x <= 1 for x in scores)


def test_quality(spark, rows):
    got = {r.doc_id: tuple(r)[1:7] for r in Q["op3_quality_rules"](spark, DATA).collect()}
    assert got == {i: plain.quality(t) for i, t in rows}


def test_shards(spark, docs):
    text = common.text_or_empty()
    narrow = docs.select("doc_id", F.crc32(text.cast("binary")).alias("text_crc32"), (F.octet_length(text).cast("long") + 1).alias("size"), "source").withColumn("u", unit(17, "doc_id", "text_crc32", "size"))
    want = plain.shards([(r.u, r.doc_id, r.text_crc32, r.size, r.source) for r in narrow.collect()], 16)
    texts = dict(docs.select("doc_id", "text").collect())
    got = {r.doc_id: r for r in Q["op5_sharding"](spark, DATA).collect()}
    assert {i: (r.shard, r.slot) for i, r in got.items()} == want
    for i, r in got.items():
        data = (texts[i] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
    # Every shard matches the mixture: a source's share of it is at most one row off its fair part.
    source = dict(docs.select("doc_id", "source").collect())
    n = collections.Counter(source.values())
    per = collections.Counter((r.shard, source[i]) for i, r in got.items())
    assert all(abs(per[k, s] - n[s] / 16) <= 2 for k in range(16) for s in n)


def test_shards_small_buckets(spark, docs):
    a = sharding.assign(docs, bucket_rows=7).select("doc_id", "shard", "slot").collect()
    assert sorted(map(tuple, a)) == sorted((r.doc_id, r.shard, r.slot) for r in Q["op5_sharding"](spark, DATA).collect())


def test_mixing(spark, docs):
    text = common.text_or_empty()
    size = {r.doc_id: len(plain.WORDS.findall(r.text or "")) for r in docs.select("doc_id", "text").collect()}
    u = docs.select("doc_id", "source", F.xxhash64(text).alias("h")).withColumn("u", unit(29, "doc_id", "h")).collect()
    want, goal = plain.mix([(r.u, r.doc_id, size[r.doc_id], r.source, r.h) for r in u])
    source = {r.doc_id: r.source for r in u}
    total = collections.Counter()
    for i, s in source.items():
        total[s] += size[i]
    got = Q["op6_mixing"](spark, DATA).collect()
    assert len(got) == len(size)
    h = {r.doc_id: r.h for r in u}
    for r in got:
        assert (r.size, r.source_size) == (size[r.doc_id], total[source[r.doc_id]])
        assert r.target == pytest.approx(goal[source[r.doc_id]]) and r.taken == want[r.doc_id, h[r.doc_id]]


def test_mixing_caps(spark):
    """Sources small enough that targets stop at three epochs, and the excess is shared again."""
    made = [(i, "w " * (1 + i % 5), s) for i, s in enumerate(["a"] * 40 + ["b"] * 3 + ["c"] * 2 + ["d"] * 30 + [None] * 2)]
    df = spark.createDataFrame(made, "doc_id long, text string, source string")
    got = mixing.plan(df, bucket_rows=4).collect()
    goal = plain.targets({s: sum(1 + i % 5 for i, _, x in made if x == s) for s in ("a", "b", "c", "d", None)})
    assert {r.source: round(r.target, 6) for r in got} == {s: round(t, 6) for s, t in goal.items()}
    assert any(r.target == 3 * r.source_size for r in got)
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size
    assert all(abs(taken[s] - t) <= 1 for s, t in goal.items())


def test_toxicity(spark, rows):
    got = {r.doc_id: r for r in Q["op7_toxicity"](spark, DATA).collect()}
    assert len(got) == len(rows)
    for i, _ in rows:
        assert got[i].held_out == plain.held_out(i) and got[i].predicted == int(got[i].score >= 0.7) and 0 <= got[i].score <= 1


def test_bpe(spark, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    want = {}
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[i] = (len(ids), plain.sha(",".join(map(str, ids))), plain.sha(t.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: tuple(r)[1:] for r in Q["op9_bpe"](spark, DATA).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == want


def test_repeats(spark, rows):
    assert {r.doc_id: tuple(r)[1:] for r in Q["op10_substring_dedup"](spark, DATA).collect()} == plain.repeats(rows)


def test_pipeline(spark, docs):
    """The whole pipeline against plain versions of its stages, one after the other."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "exact dedup", "n-gram Jaccard join", "mixing", "BPE"]
    kept_by_rules = {r.doc_id for r in Q["op3_quality_rules"](spark, DATA).filter("kept").select("doc_id").collect()}  # its columns: test_quality; verdict: the SQL
    now = [(r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id in kept_by_rules]
    keep = plain.exact([(i, t) for i, t, _ in now])
    now = [r for r in now if keep[r[0]][2]]
    group = plain.near([(i, t) for i, t, _ in now], 5, 80)
    now = [r for r in now if group[r[0]][1] == r[0]]
    hashes = spark.createDataFrame([(i, t, s) for i, t, s in now], "doc_id long, text string, source string").withColumn("h", F.xxhash64("text")).withColumn("u", unit(29, "doc_id", "h")).collect()
    size = {i: len(plain.WORDS.findall(t)) for i, t, _ in now}
    taken, _ = plain.mix([(r.u, r.doc_id, size[r.doc_id], r.source, r.h) for r in hashes], whole=True)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    want = collections.Counter()
    for r in hashes:
        ids = t.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id, len(ids), plain.sha(",".join(map(str, ids))), plain.sha(t.decode(ids, skip_special_tokens=False))] += taken[r.doc_id, r.h] // size[r.doc_id]
    got = collections.Counter(tuple(r) for r in corpus_pipeline.run(spark, DATA).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == +want and len(got) > 50
    # Stages by themselves, as a driver runs them: tables in between, columns of documents out.
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = common.saved(stage(spark, at, DATA), "stage")
        assert at.columns == docs.columns
    assert collections.Counter(r.doc_id for r in at.collect()) == collections.Counter({i: sum(n for k, n in want.items() if k[0] == i) for i in {k[0] for k in +want}})
