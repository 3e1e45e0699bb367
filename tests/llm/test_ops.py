"""Every opN query over a whole table, against SQL or a brute-force version."""

import html
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import sentencepiece
from test_llm import WORDS, brute_components, brute_simhash, covered, sha

from chronicle.llm import piece_codec
from chronicle.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def result(spark, n):
    return {r.doc_id: r for r in QUERIES[next(q for q in QUERIES if q.startswith(f"op{n}_"))](spark, SF).collect()}


def test_op1(spark, rows):
    got = result(spark, 1)
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows}
    assert {i: r.held_out for i, r in got.items()} == held and all(0 <= r.score <= 1 for r in got.values())
    lettered = {i: any(c.isalpha() for c in t or "") for i, t, _ in rows}
    assert all((got[i].lang_pred == "und") == (not lettered[i]) for i in lettered)
    right = [got[i].lang_pred == lang for i, t, lang in rows if held[i] and lang is not None and lettered[i]]
    assert len(right) > 30 and sum(right) / len(right) > 0.97


def test_op2(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r for r in QUERIES["op2_html_text"](spark, SF).collect()}
    assert set(got) == set(pages)
    for i, page in pages.items():
        article = re.search(r"<article>(.*)</article>", page.html or "", re.DOTALL)
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br" in x else "", re.sub(r"<br[^>]*>", " ", x))).split()) for x in re.split(r"</?(?:h1|p)\b[^>]*>", article[1])] if article else []
        want = "\n".join(x for x in lines if x)
        assert (got[i].url, got[i].text, got[i].n_chars) == (page.url, want, len(want))


def test_op3(spark, rows):
    sp, got = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model()), result(spark, 3)
    for i, t, _ in rows:
        ids = sp.encode(t or "", add_eos=True)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)))


def test_op4(spark, rows):
    want = {i: {k for k, y in enumerate(m) if y} for i, (_, m) in covered(rows, 50).items() if any(m)}
    got = defaultdict(set)
    for r in QUERIES["op4_suffix_dedup"](spark, SF).collect():
        assert r.end_word - r.start_word >= 50 and all(s < r.doc_id for s in r.source_doc_ids)
        got[r.doc_id].update(range(r.start_word, r.end_word))
    assert dict(got) == want and want


def test_op5(spark, rows):
    got, ordered = result(spark, 5), sorted((i, t or "") for i, t, _ in rows)
    bag = lambda t: Counter(WORDS.findall(t))
    like = lambda a, b: 1.0 if not (a or b) else sum((a & b).values()) / sum((a | b).values())
    errors, prints = [], defaultdict(set)
    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha(edited))
        prints[t].add(r.fingerprint)
        errors += [r.near_edited - like(bag(t), bag(edited)), r.near_next - like(bag(t), bag(after))]
    assert all(len(x) == 1 for x in prints.values())
    assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.07 and max(map(abs, errors)) < 0.3


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = db.sql(SQL[name])
    assert sorted(want.columns) == columns
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want.select(*columns).fetchall()))


def test_op7(spark, rows):
    got = result(spark, 7)
    shards, size, groups = defaultdict(list), Counter(), defaultdict(set)
    for i, t, _ in rows:
        r, raw = got[i], (t or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None) and 0 <= r.shard < 24
        shards[r.shard].append(r.slot)
        size[r.shard] += r.size
        groups[t or ""].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values()) and all(len(g) == 1 for g in groups.values())
    assert max(size.values()) * 24 < 1.03 * sum(size.values()) and min(size.values()) * 24 > 0.97 * sum(size.values())


def test_op8(spark, rows):
    prints = [(i, brute_simhash(t)) for i, t, _ in rows]
    want = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    assert {i: (r.fingerprint, r.component_id) for i, r in result(spark, 8).items()} == {i: (f"{p:016x}", want[i]) for i, p in prints}


def test_queries_are_one_for_each_operator():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 14)]
