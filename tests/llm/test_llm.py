"""The training-data operators against brute force, on small and awkward inputs."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from chronicle.llm import decontaminate, fingerprints, html_text, language_id, line_dedup, piece_codec, sharding, simhash_dedup, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=3, n=60):
    """Documents with copies, near copies, shared lines and passages, nulls, blanks, one long text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    text = lambda k: "\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 14))) for _ in range(k))
    line, passage = "This line stands in very many of the documents here.", text(9)
    out = []
    for i in range(n):
        t = text(rng.randint(1, 12))
        if i % 4 == 0:
            t += "\n  " + (line.upper() if i % 8 else line) + " \t"
        if i % 7 == 0:
            t = t + " " + passage + "\n" + text(1)
        out.append(t)
    out += [out[3], out[3], out[5].replace(out[5].split()[0], "changed", 1), None, "", " \n\t", "a", "é ñ", "İstanbul\x00 x\r\ny", line, "\n".join([line] * 3), text(600)]
    return [(2 * i + 1, t, None if t is None else "en", "s", 0) for i, t in enumerate(out)]


def docs(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA).repartition(3)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


def test_line_dedup(spark):
    rows = corpus()
    held = {}
    for i, t, *_ in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                held.setdefault(k, set()).add(i)
    drop = {k: max(v) for k, v in held.items() if len(v) >= 5}
    assert drop
    want = {}
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if drop.get(key(x), i) == i]
        want[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    got = {r.doc_id: (r.kept_text, r.n_lines, r.n_dropped) for r in line_dedup.with_line_dedup(docs(spark)).collect()}
    assert got == want
    assert line_dedup.with_line_dedup(docs(spark, [])).count() == 0
    extra = docs(spark).withColumns({"key": F.lit(1), "a": F.lit(2), "dropped2": F.lit(3)})
    assert line_dedup.with_line_dedup(extra).count() == len(rows)
    nulls = [(None, "x" * 50 + "\nz", None, None, None)] * 6 + [(1, "x" * 50, None, None, None)] * 2
    assert sorted((r.n_dropped, r.kept_text) for r in line_dedup.with_line_dedup(docs(spark, nulls)).collect()) == [(0, "x" * 50)] * 2 + [(1, "z")] * 6


def test_sharding(spark):
    rows = corpus() + [(10_000 + k, "hot copy " * 20, None, None, None) for k in range(300)] + [(None, "n", None, None, None), (5555, "t", None, None, None), (5555, "t", None, None, None)]
    got = sharding.shard_by_bytes(docs(spark, rows)).collect()
    assert sorted((r.size, r.doc_id or -1) for r in got) == sorted((len((t or "").encode()) + 8, i or -1) for i, t, *_ in rows)
    slots, size = {}, Counter()
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        size[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(size) <= set(range(24))
    largest = max(r.size for r in got)
    assert all(abs(size[k] - sum(size.values()) / 24) <= largest + 0.01 * sum(size.values()) for k in size)
    import zlib

    assert all(r.text_crc32 == zlib.crc32((dict((i, t) for i, t, *_ in rows)[r.doc_id] or "").encode()) for r in got)
    assert sharding.shard_by_bytes(docs(spark, [])).count() == 0


def brute_simhash(text, size=4):
    words = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + size]).encode(), 42) for k in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(items, linked):
    root = {i: i for i, _ in items}
    for i, a in items:
        for j, b in items:
            if i < j and root[i] != root[j] and linked(a, b):
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    return root


def test_simhash(spark):
    rows = corpus()
    base = " ".join(f"w{k}" for k in range(300))
    rows += [(1000 + k, base.replace(f"w{7 * k + 3} ", "edit ", 1), None, None, None) for k in range(30)]
    prints = [(i, brute_simhash(t)) for i, t, *_ in rows]
    want = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert got == {i: (p, want[i]) for i, p in prints}
    assert len({c for i, (_, c) in got.items() if i >= 1000}) < 20
    assert simhash_dedup.near_duplicates(docs(spark, [])).count() == 0
    ties = [(None, "a b c d", None, None, None), (4, "a b c d", None, None, None), (4, "a b c d", None, None, None), (None, None, None, None, None)]
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in simhash_dedup.near_duplicates(docs(spark, ties)).collect()) == [(0, 0), (0, 4), (4, 4), (4, 4)]


def test_tiles_hold_all_links(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(200)]
    prints = sorted({s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for s in seeds for _ in range(10)})
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    links = simhash_dedup.near_links(df)
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash_dedup.components(links).collect()}
    want = brute_components([(p, p) for p in prints], lambda a, b: (a ^ b).bit_count() <= 4)
    group = lambda roots: {frozenset(k for k, v in roots.items() if v == r) for r in set(roots.values())}
    assert group({p: got.get(p, p) for p in prints}) == group(want)


def test_piece_codec(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    coder = piece_codec.codec(piece_codec.default_model())
    rng = random.Random(2)
    awkward = ["", " ", "  a  b ", "▁", "a▁ b", "</s><0x0A>", "\x00", "日本語 テキスト", "😀👨‍👩‍👧", "=" * 60, "a" * 300, "\r\n\t", "é", " x"]
    pieces = [sp.id_to_piece(i).replace("▁", " ") for i in range(300, sp.get_piece_size())]
    awkward += ["".join(rng.choice("abcdeth  ▁\n éß日<>s/0x1.=-_'") for _ in range(rng.randint(1, 50))) for _ in range(800)]
    awkward += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(800)]
    for t in awkward:
        ids = sp.encode(t, add_eos=True)
        assert coder.encode(t) == ids, t
        assert coder.decode(ids) == sp.decode(ids), t
    rows = corpus() + [(10_000 + k, t, None, None, None) for k, t in enumerate(awkward)]
    got = {r.doc_id: r for r in piece_codec.encode_digests(docs(spark, rows)).collect()}
    for i, t, *_ in rows:
        ids = sp.encode(t or "", add_eos=True)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)))
    assert piece_codec.encode_digests(docs(spark, [])).count() == 0
    assert piece_codec.encode_ids(docs(spark, rows[:5])).where("doc_id = 1").first().ids == sp.encode(rows[0][1], add_eos=True)


def covered(rows, size):
    """For each doc_id its words and which of them a window covers that a smaller doc_id has."""
    ids = sorted((i, WORDS.findall(t or "")) for i, t, *_ in rows)
    first, out = {}, {}
    for i, words in ids:
        keys = [tuple(words[k : k + size]) for k in range(len(words) - size + 1)]
        mask = [False] * len(words)
        for k, x in enumerate(keys):
            if first.get(x, i) < i:
                mask[k : k + size] = [True] * size
        for x in keys:
            first.setdefault(x, i)
        out[i] = (words, mask)
    return out


def test_substring_dedup(spark):
    rows = corpus()
    want = {i: (len(w), sum(m), " ".join(x for x, y in zip(w, m, strict=True) if not y)) for i, (w, m) in covered(rows, 13).items()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(docs(spark)).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 500
    assert substring_dedup.parse(docs(spark)).where("end_word - start_word < 13 OR source_doc_id >= doc_id").count() == 0
    assert substring_dedup.remove_repeats(docs(spark, [])).count() == 0
    long = " ".join(f"w{k}" for k in range(20))
    null = [(None, long, None, None, None), (1, long, None, None, None), (1, long, None, None, None), (2, long, None, None, None)]
    assert sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.remove_repeats(docs(spark, null)).collect()) == [(0, 0), (1, 0), (1, 0), (2, 20)]


def test_suffix_dedup(spark):
    rows = corpus(n=90)
    want = {i: {k for k, y in enumerate(m) if y} for i, (w, m) in covered(rows, 50).items() if any(m)}
    got = {}
    for r in suffix_dedup.shared_passages(docs(spark, rows)).collect():
        assert r.end_word - r.start_word >= 50 and all(s < r.doc_id for s in r.source_doc_ids)
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert got == want and len(want) > 5
    assert suffix_dedup.shared_passages(docs(spark, [])).count() == 0


def test_decontaminate(spark):
    rng = random.Random(9)
    words = [f"word{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(words) for _ in range(n))) for k, n in enumerate([3, 5, 8, 20, 40, 60, 60])] + [(50, None), (51, " "), (52, "Word1 WORD2 word3")]
    rows = []
    for i in range(120):
        w = [rng.choice(words) for _ in range(rng.randint(0, 150))]
        if i % 3 == 0:
            own = items[rng.randrange(7)][1].split()
            if i % 2 and len(own) > 30:
                own[rng.randrange(3)] = "edited"
            at = rng.randrange(len(w) + 1)
            w = w[:at] + [x.upper() for x in own] + w[at:]
        rows.append((i, " ".join(w), None, None, None))
    rows += [(900, None, None, None, None), (901, "", None, None, None), (902, "xx word1 word2  word3", None, None, None)]
    shingles = lambda w: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    want = {}
    for i, t, *_ in rows:
        w = WORDS.findall((t or "").lower())
        for k, x in items:
            own = WORDS.findall((x or "").lower())
            for a in range(len(w) - len(own) + 1 if own else 0):
                x1, x2 = shingles(w[a : a + len(own)]), shingles(own)
                s = sum((x1 & x2).values()) / sum((x1 | x2).values())
                if s >= 0.8 and s > want.get((i, k), (0,))[0]:
                    want[i, k] = (s, a, a + len(own))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.end_word) for r in decontaminate.leaks(docs(spark, rows), benchmark).collect()}
    assert got == want and len(want) > 30 and any(v[0] < 1 for v in want.values())
    kept = decontaminate.without_leaks(docs(spark, rows).withColumn("item_id", F.lit(1)), benchmark)
    assert {r.doc_id for r in kept.collect()} == {i for i, *_ in rows} - {i for i, _ in want} and "item_id" in kept.columns
    assert decontaminate.leaks(docs(spark, []), benchmark).count() == 0 and decontaminate.leaks(docs(spark), benchmark.limit(0)).count() == 0


def test_fingerprints(spark):
    rows = corpus()
    out = fingerprints.in_order(docs(spark, rows)).where("NOT guest").collect()
    ordered = sorted((i, t or "") for i, t, *_ in rows)
    assert {r.doc_id: r.next_text for r in out} == {i: ordered[(k + 1) % len(ordered)][1] for k, (i, _) in enumerate(ordered)}
    many = spark.range(4000).selectExpr("id * 3 AS doc_id", "concat('text ', id) AS text")
    follows = {r.doc_id: r.next_text for r in fingerprints.in_order(many).where("NOT guest").collect()}
    assert follows == {3 * k: f"text {(k + 1) % 4000}" for k in range(4000)}
    assert fingerprints.in_order(many.limit(0)).count() == 0 and fingerprints.in_order(many.limit(1)).where("NOT guest").first().next_text.startswith("text")
    pairs = spark.createDataFrame([(0, "a b c d " * 5, "a b c d " * 5), (1, "", " \n"), (2, "a", ""), (3, " ".join(f"w{k}" for k in range(200)), " ".join(f"w{k}" for k in range(100, 300)))], "k long, x string, y string")
    signed = fingerprints.signatures(fingerprints.bags(pairs, ["k"], ["x", "y"]), ["k"], 2)
    near = {r.k: r.s for r in pairs.join(signed, "k", "left").select("k", fingerprints.likeness(F.col("sig0"), F.col("sig1")).alias("s")).collect()}
    assert near[0] == 1.0 and near[1] == 1.0 and near[2] == 0.0 and abs(near[3] - 1 / 3) < 0.3


def test_signatures_agree_as_often_as_bags_are_alike(spark):
    rng = random.Random(1)
    rows, like = [], []
    for k in range(150):
        x, y = ([rng.choice("abcdefghijkl") for _ in range(rng.randint(5, 40))] for _ in range(2))
        a, b = Counter(x), Counter(y)
        like.append(sum((a & b).values()) / sum((a | b).values()))
        rows.append((k, " ".join(f"{w}{k}" for w in x), " ".join(f"{w}{k}" for w in y)))
    pairs = spark.createDataFrame(rows, "k long, x string, y string")
    signed = fingerprints.signatures(fingerprints.bags(pairs, ["k"], ["x", "y"]), ["k"], 2)
    got = [r.s for r in signed.orderBy("k").select(fingerprints.likeness(F.col("sig0"), F.col("sig1")).alias("s")).collect()]
    errors = [g - w for g, w in zip(got, like, strict=True)]
    assert abs(sum(errors) / 150) < 0.025 and math.sqrt(sum(e * e for e in errors) / 150) < 0.11


def test_language_id(spark):
    rng = random.Random(4)
    parts = {"en": "the and ing of to that er", "de": "der die und sch ein ich ü", "fr": "le la que eau é tion un", "es": "el los de ción que ñ ado", "it": "il che gli zione della per una"}
    rows = []
    for k in range(500):
        lang = rng.choice(list(parts))
        p = parts[lang].split()
        rows.append((k, " ".join("".join(rng.choice(p) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(8, 60))), lang, "s", 0))
    rows += [(900, None, "en", "s", 0), (901, "123 !?", "en", "s", 0), (902, "", None, "s", 0), (None, "the and", "en", "s", 0), (903, "the the", None, "s", 0)]
    d = docs(spark, rows)
    model = language_id.train(d)
    assert model.languages == sorted(parts) and model.code.shape == (5, 15)
    got = {r.doc_id: r for r in language_id.predict(d, model).collect()}
    held = {r.doc_id for r in d.where(language_id.held_out(F.col("doc_id"))).collect()}
    right = [got[i].lang_pred == lang for i, _, lang, *_ in rows if i is not None and i < 500 and i in held]
    assert len(right) > 80 and sum(right) / len(right) > 0.97
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902)) and all(0 <= r.score <= 1 for r in got.values())
    none = language_id.train(d.limit(0))
    assert {r.lang_pred for r in language_id.predict(d, none).collect()} == {"und"}
    single = language_id.train(d.where("lang = 'en'"))
    assert {r.lang_pred for r in language_id.predict(d, single).collect()} == {"en", "und"}


@pytest.mark.parametrize("n", [2, 3, 6, 9, 30])
def test_codewords_are_apart(n):
    code = language_id.codewords(n)
    apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
    assert apart >= 1 and (n < 4 or apart >= 4)


PAGES = [
    ("<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Big &amp; small</h1><p>One\n  two<br>three <b>four</b>.<p>Auxpa.</article><footer>&copy; me</footer>", "Big & small\nOne two three four.\nAuxpa."),
    ("<div class='cookie-notice'><p>We use cookies on this site, do you agree to all of them?</p></div><main><header><h1>Title</h1></header><p>Text &lt;here&gt; &#233;.</p><section class=comments><p>Nice post, I liked it very much indeed!</p></section></main>", "Title\nText <here> é."),
    ("<p>" + "word " * 30 + "</p><p>" + "more " * 25 + "</p><ul><li><a href=a>x</a></li><li><a href=b>y</a></li></ul>", "word " * 29 + "word\n" + "more " * 24 + "more"),
    ("<article><p>a</p><aside><p>sidebar text of some length here</p></aside><form><label>Name</label><input></form><script>if (a < b) {'<p>no</p>'}</script><p>b &am", "a\nb &am"),
    ("", ""), (None, ""), ("<!-- only a comment", ""), ("<nav>x</nav>", ""),
]


def test_html_text(spark):
    pages = spark.createDataFrame([(k, "u", h) for k, (h, _) in enumerate(PAGES)], "page_id long, url string, html string").withColumn("blocks", F.lit(1))
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got == {k: t for k, (_, t) in enumerate(PAGES)}
    assert html_text.extract(pages.limit(0)).count() == 0


def said(tree, row):
    while not isinstance(tree, float):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree >= 0.5


def test_tree_fits_its_table():
    tree, rows = html_text.train_tree(), html_text.labelled_rows()
    assert sum(said(tree, row) == bool(row[-1]) for row in rows) > 0.99 * len(rows) and 100 < len(rows) < 1200

    def used(t):
        return set() if isinstance(t, float) else {html_text.FEATURES[t[0]]} | used(t[2]) | used(t[3])

    assert html_text.FEATURES[tree[0]] not in ("tag", "name") and {"words", "links", "group_words", "group_links"} & used(tree) and {"words_before", "links_before", "words_after", "links_after"} & used(tree)


ARTICLE = "<article><h1>{}</h1><p>" + "word " * 60 + "</p>{}<p>" + "more " * 70 + "</p></article>"


@pytest.mark.parametrize(
    ("head", "middle", "line"),
    [
        ("<a href=x>Linked heading</a>", "<p>" + "short " * 20 + "</p>", "Linked heading"),
        ("T", "<p><a href=x>" + "all linked " * 11 + "</a></p>", ("all linked " * 11).strip()),
        ("T", "<p class='share-price'>The share price rose</p>", "The share price rose"),
        ("T", "<section id='side-effects'><p>" + "effects " * 30 + "</p></section>", ("effects " * 30).strip()),
        ("T", "<p>before <span class='advert'>BUY NOW</span> after</p>", "before after"),
        ("T", "<p>before <span hidden>not seen</span> after <i style='display: none'>nor this</i>end</p>", "before after end"),
        ("T", "<ul><li class=ad>BUY<li>first item<li>second item</ul>", "first item\nsecond item"),
    ],
)
def test_html_text_of_an_article(head, middle, line):
    found = html_text.blocks(ARTICLE.format(head, middle))
    tree = html_text.train_tree()
    kept = [f[0] for f, x in zip(found, html_text.features(found), strict=True) if said(tree, x)]
    shown = "T" if head == "T" else "Linked heading"
    middle_lines = line.split("\n") if head == "T" else [("short " * 20).strip()]
    assert kept == [shown, ("word " * 60).strip(), *middle_lines, ("more " * 70).strip()]
