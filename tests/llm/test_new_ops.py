"""Operators 11 to 13: ids against the library and through files, ranks and draws against brute force."""

import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronicle.llm import lexical_search, resampling, token_ids
from chronicle.llm.elias_fano import EliasFano
from chronicle.llm.queries import QUERIES
from chronicle.llm.runs import runs, table
from chronicle.llm.words import buffers

SF = "/root/testdata/sf0.001"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROWS = [(None, "the cat sat"), (None, "the cat sat"), (None, None), (3, "The CAT, the dog; the élan"), (3, "dog dog dog"), (4, ""), (5, None), (6, " \n\t"), (7, " ".join(f"word{k % 977}x{k}" for k in range(30_000))), (-5, "negative id cat"), (2**62, "large id dog"), (8, "the cat sat"), (9, "the cat sat")]
CLASH = "row term item_id shard tie null ids n_tokens start df w x score rank n tf postings words counts n_words _range _row weight".split()


@given(st.lists(st.integers(0, 2**64 - 1), max_size=700), st.integers(0, 63))
@settings(max_examples=80, deadline=None)
def test_elias_fano_gives_back_every_value(values, shift):
    held = np.sort(np.array([v >> shift for v in values], dtype=np.uint64))
    code = EliasFano.of(held)
    again = EliasFano.load(code.n, code.width, code.parts())
    assert (again.select(np.arange(len(held))) == held).all()
    assert [int(again.select(np.array([k]))[0]) for k in range(0, len(held), 97)] == held[::97].tolist()
    with pytest.raises(IndexError):
        again.select(np.array([len(held)]))


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 200_000)).astype(np.uint64)
    code = EliasFano.of(ends)
    assert 8 * sum(map(len, code.parts())) / len(ends) < math.log2(int(ends[-1]) / len(ends)) + 2.3


def test_runs():
    texts = ["ab, c", None, "", "éa-b", "--", "xx"]
    data, bounds = buffers(pa.array(texts))
    found = runs(data, bounds, table(b"abcdefghijklmnopqrstuvwxyz"))
    assert found.strings.to_pylist() == ["ab", "c", "éa", "b", "xx"] and found.text_of().tolist() == [0, 0, 3, 3, 5]


def test_pieces_are_the_librarys():
    rnd, code = random.Random(3), token_ids.Encoder(token_ids.default_tokenizer())
    parts = ["a", "b", "Z", "don't", "'s", "'ll", "é", "é", ".", ",", "!?", "'", "<|endoftext|>", "<|startoftext|>", " ", "\n", "\t", " ", " ", "\x85", "\x1c", "\x0b", "1", "23", "日本", "😀", "=", "̸", ";", "́", "İ", "Σ", "ΑΣ", "ﬁ", "-", "_", "\x00", "|", "<", ">", "‍", "ß", "ǅ", "K", "क़"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 25))) for _ in range(6000)] + ["", "x" * 5000]
    want = [e.ids + [2] for e in code.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for a, z in ((0, 3000), (3000, len(texts))):
        ids, upto = code.encode(*buffers(pa.array(texts[a:z])))
        assert [ids[x:y].tolist() for x, y in zip(upto, upto[1:], strict=False)] == want[a:z]


def test_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(token_ids, "MEMO", 3)
    code = token_ids.Encoder(token_ids.default_tokenizer())
    for k in range(5):
        text = " ".join(f"piece{k}{j}" for j in range(4)) + " " + "long" * 40
        ids, _ = code.encode(*buffers(pa.array([text])))
        assert ids.tolist() == code.tokenizer.encode(text, add_special_tokens=False).ids + [2] and len(code.known) <= 4


def id_rows(spark, docs, path, **how):
    token_ids.write(docs, path, **how)
    return token_ids.read(spark, path).collect()


def test_op11(spark):
    tokenizer = Tokenizer.from_file(token_ids.default_tokenizer())
    want, before = {}, 0
    for r in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
        want[r.doc_id] = (before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        before += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op11_token_ids"](spark, SF).collect()} == want


def test_id_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_ids, "SHARD_DOCS", 3)
    tokenizer = Tokenizer.from_file(token_ids.default_tokenizer())
    many = ROWS + [(100, f"text {k}") for k in range(20)] + [(k, f"the {k}th") for k in range(101, 110)]
    docs = spark.createDataFrame(many, "doc_id long, text string").withColumns({c: F.lit(7) for c in CLASH}).repartition(3)
    got = id_rows(spark, docs, f"{tmp_path}/a")
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    ids = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple(ids(t))) for i, t in many)
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    shards = spark.read.parquet(f"{tmp_path}/a/shards").collect()
    assert len(shards) > 5 and sum(s.documents for s in shards) == len(many)
    # The 20 rows of one id do not all lie in one shard, and no shard has most of the rows.
    assert max(s.documents for s in shards) < 20
    raw = token_ids.Shard(f"file://{tmp_path}/a/{max(shards, key=lambda s: s.documents).file}")
    assert raw.head["width"] == 2 and raw.bounds(1, 2).tolist() == raw.bounds(0, 2)[1:].tolist()
    assert id_rows(spark, docs.limit(0), f"{tmp_path}/b") == []


def test_files_of_stopped_tasks_do_not_count(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    want = sorted(map(str, id_rows(spark, docs, f"{tmp_path}/a")))
    (tmp_path / "a" / "000000-stopped.ids").write_bytes(b"TOKENIDS half a file")
    assert sorted(map(str, token_ids.read(spark, f"{tmp_path}/a").collect())) == want
    as_bytes = token_ids.read(spark, f"{tmp_path}/a", as_bytes=True).collect()
    assert sorted(np.frombuffer(r.ids, "<u4").tolist() for r in as_bytes) == sorted(r.ids for r in token_ids.read(spark, f"{tmp_path}/a").collect())


def test_wide_ids(spark, tmp_path):
    """A vocabulary of more than 2**16 ids takes four bytes."""
    with open(token_ids.default_tokenizer()) as f:
        made = json.load(f)
    made["added_tokens"].append({"id": 70_000, "content": "<far>", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True})
    for t in range(49_408, 70_000):
        made["model"]["vocab"][f"{t}"] = t
    (tmp_path / "far.json").write_text(json.dumps(made))
    docs = spark.createDataFrame([(1, "a <far> b")], "doc_id long, text string")
    want = Tokenizer.from_file(str(tmp_path / "far.json")).encode("a <far> b", add_special_tokens=False).ids
    assert id_rows(spark, docs, f"{tmp_path}/w", tokenizer=str(tmp_path / "far.json"))[0].ids == [*want, 2] and max(want) >= 1 << 16


def brute_ranks(rows, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOWER))
    docs = [(i, Counter(terms(t))) for i, t in rows if terms(t)]
    nn, ll = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, words in asked.items():
        found = []
        for i, c in docs:
            m = 10 + 90 * sum(c.values()) * nn // ll
            score = sum(math.floor(1000 * math.log((2 * nn + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in words if c[w])
            if score > 0:
                found.append((-score, i is not None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "cat DOG"), (1, "sat"), (2, "the the the"), (3, None), (None, "élan"), (4, "unknown"), (5, ""), (6, "word5x982 word6x6 id")]


@pytest.mark.parametrize("few", [True, False])
def test_ranks(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(lexical_search, "MOST_TERMS", 2)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({c: F.lit(7) for c in CLASH if c != "item_id"})
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({c: F.lit(7) for c in CLASH}).repartition(3)
    shown = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert shown(lexical_search.ranked(docs, items)) == brute_ranks(ROWS, ITEMS)
    assert shown(lexical_search.ranked(docs, items, 2)) == brute_ranks(ROWS, ITEMS, 2)
    assert shown(lexical_search.ranked(docs.limit(0), items)) == shown(lexical_search.ranked(docs, items.limit(0))) == []


def test_op12_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op12_lexical_search"](spark, SF).collect()), key=str) == brute_ranks(rows, items)


def test_a_common_term_is_no_large_row(spark):
    docs = spark.createDataFrame([(k, "common " * 300) for k in range(6000)], "doc_id long, text string").repartition(4)
    index = lexical_search.postings(docs)
    assert index.documents == 6000 and index.terms == 1_800_000 and index.buckets.agg(F.max(F.size("postings"))).first()[0] <= 1000
    best = lexical_search.search(index, spark.createDataFrame([(1, "common")], "item_id long, term string")).collect()
    assert best == []  # every document has it, so it says nothing


def brute_draw(rows, target, ngrams=1, buckets=10_000, percent=10, least=20, seed=2024):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, ngrams + 1) for i in range(len(w) - n + 1)]

    own = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for *_, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    ss, tt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in s}
    out = []
    for i, words, f in own:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is not None, x[0] or 0))
    rank = {id(x): k for k, x in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted(((*x, rank.get(id(x))) for x in out), key=str)


@pytest.mark.parametrize(("ngrams", "percent", "least"), [(1, 10, 20), (2, 50, 1), (3, 100, 0), (1, 0, 1)])
def test_draws(spark, ngrams, percent, least):
    rows = ROWS + [(1000 + k, f"some words of text {k} that the target has or has not {k % 7}") for k in range(60)]
    target = ["the target has words", None, "cat"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in CLASH}).repartition(5)
    to = spark.createDataFrame([(t,) for t in target], "text string")
    shown = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert shown(resampling.resampled(docs, to, ngrams, 500, percent, least)) == brute_draw(rows, target, ngrams, 500, percent, least)
    assert shown(resampling.resampled(docs.limit(0), to)) == [] and len(shown(resampling.resampled(docs, to.limit(0)))) == len(rows)


def test_op13_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = [(a, c, d, e, f) for a, _, c, d, e, f in brute_draw(rows, target)]
    assert sorted((tuple(r) for r in QUERIES["op13_resampling"](spark, SF).collect()), key=str) == sorted(want, key=str)
