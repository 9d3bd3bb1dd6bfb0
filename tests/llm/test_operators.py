"""Each operator against its plain definition, over nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import decontam, extract, linededup, mixture, quality, shards, simhash, spans, tokens, warc, words
from tests.llm import brute

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, part int, size string"


def _texts():
    rnd = random.Random(11)
    vocab = ["And", "the", "über", "x.", "a|b", "Ça", "it's", "12,5", "日本", "<|endoftext|>", "ing", "of", "to", "%%%", "<b>", "é", "zu", "der"] + [f"w{k}" for k in range(60)]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    base = say(120)
    passage = say(35)
    out = ["", None, "   \t\n ", "one", "two words", "three of them", base, base, base + " more", say(60) + " " + passage + " " + say(10), passage.upper(), passage + "\n" + say(30)]
    out += ["\n".join([say(5), "same line here", say(4), "same line here"]), "#$% | < > ** &", say(4000), " ".join(["loop again now"] * 40), "a b c\n\n \na b c\n"]
    out += [say(rnd.randrange(1, 90)) for _ in range(40)]
    out += ["\n".join(rnd.choice(["l1 x", "l2", "l3 y", ""]) for _ in range(rnd.randrange(1, 9))) for _ in range(12)]
    return out


@pytest.fixture(scope="module")
def texts():
    return _texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rnd = random.Random(5)
    rows = [(k * 3, t, None if k % 7 == 0 else "en", rnd.choice(["b", "a", None, "é"]), None, 1, 2, "x") for k, t in enumerate(texts)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark, texts):
    """Rows without an id, repeated rows, and one id with two texts."""
    rows = [(None, t) for t in texts[:9]] + [(5, texts[6])] * 3 + [(7, "p q r"), (7, "p q s"), (1, texts[14])]
    return spark.createDataFrame([(i, t, "", "s", 0, 0, 0, "") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark, texts):
    return spark.createDataFrame([(1, texts[9]), (20, "three OF them"), (3, ""), (4, None), (5, "über"), (20, "three OF them"), (None, "loop again now")], "item_id long, text string")


def ordered(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def by_id(df, columns=None):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=lambda r: (r[0] is None, repr(r[0]).zfill(9), repr(r)))


def test_words_and_windows_over_slices(texts):
    column = pa.array(texts)
    for limit in (64, 1000, 1 << 20):
        got = []
        for _, _, data, offs in words.slices(column, limit):
            v = words.Words(data, offs)
            got += [[data[s:e].tobytes().decode() for s, e in zip(v.start[a:b], v.end[a:b], strict=True)] for a, b in zip(v.first, v.first[1:], strict=False)]
        assert got == [brute.words(t) for t in texts]
    assert list(words.later(np.array([3, 1, 3, 3, 2, 1], np.uint64))) == [False, False, True, True, False, True]


def _balanced(length=2048, start="ab" * 4):
    """Two different words of one length, first letters and letter counts, in whose difference polynomials modulo 2**64 vanish."""
    plus = [bin(k).count("1") & 1 for k in range(length)]
    return start + "".join("ab"[x] for x in plus), start + "".join("ba"[x] for x in plus)


def test_hashes_of_balanced_words_differ():
    a, b = _balanced()
    for x, y in [(a, b), _balanced(128), ("a" * 9, "a" * 10), ("\0", "\0\0")]:
        data, offs = np.frombuffer(f"{x} {y}".encode(), np.uint8), np.array([0, len(x) + len(y) + 1])
        v = words.Words(data, offs)
        h = v.hashes()
        assert len(h) == 2 and h[0] != h[1]
    signs = np.array([bin(k).count("1") & 1 for k in range(16)])
    h = np.random.default_rng(0).integers(0, 1 << 63, 2, dtype=np.uint64)
    both = np.concatenate([h[signs], h[1 - signs]])
    _, g = words.windows(both, np.array([0, 16, 32]), 16)
    assert g[0] != g[1]
    for n in range(1, 40):  # a window's hash depends on its words and their order only
        w = np.random.default_rng(n).integers(0, 3, 60).astype(np.uint64)
        start, g = words.windows(w, np.array([0, 25, 60]), n)
        seen = {}
        for s, x in zip(start.tolist(), g.tolist(), strict=True):
            assert seen.setdefault(tuple(w[s : s + n].tolist()), x) == x
        assert len(set(seen.values())) == len(seen) and len(start) == max(0, 26 - n) + max(0, 36 - n)


def test_balanced_words_in_every_operator(spark, items):
    from tokenizers import Tokenizer

    a, b = _balanced()
    say = lambda x: " ".join([x] * 12)
    rows = [(1, say(a)), (2, say(b)), (3, f"{a}\n{b}\nx"), (4, " ".join(f"{x}{k}" for k in range(3) for x in (a, b)))]
    df = spark.createDataFrame([(i, x, "", "", 0, 0, 0, "") for i, x in rows], SCHEMA)
    known = [(1, say(a))]
    assert by_id(decontam.contamination(df, spark.createDataFrame(known, "item_id long, text string"))) == by_id_rows(brute.contamination(rows, known))
    assert by_id(spans.remove_repeats(df)) == by_id_rows(brute.spans(rows))
    for r in quality.measure(df).collect():
        n = brute.base_counts(dict(rows)[r.doc_id])
        assert (r.n_words, r.n_dup_lines, r.n_repeat_words) == (n[0], n[3], n[4])
    model = Tokenizer.from_file(PATH)
    want = {d: zlib.crc32(np.array([*model.encode(x, add_special_tokens=False).ids, 1], "<u4").tobytes()) for d, x in rows}
    assert {r.doc_id: r.ids_crc32 for r in tokens.digest(tokens.write_tokens(df, PATH)).collect()} == want


def test_words_of_one_hash_keep_their_own_ids(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(words.Words, "hashes", lambda v: (v.end - v.start).astype(np.uint64))
    texts = [" ".join(f"sameletters{k % 7}{x}" for k in range(20)) for x in "abcabc"] + ["x" * 300 + " " + "x" * 299 + "y"]
    flat, sizes = tokens.Encoder(PATH).column(pa.array(texts), 1)
    want = [[*e.ids, 1] for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == [len(x) for x in want] and flat.tolist() == sum(want, [])


def test_shards(docs, odd, empty):
    assert by_id(shards.shard(docs)) == by_id_rows(brute.shards(ordered(docs)))
    got = shards.shard(odd).collect()
    assert len(got) == odd.count()
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert shards.shard(empty).count() == 0


def by_id_rows(rows):
    return sorted(rows, key=lambda r: (r[0] is None, repr(r[0]).zfill(9), repr(r)))


def test_mixture(docs, odd, empty):
    rows = mixture.mix(docs).collect()
    assert len(rows) == docs.count() and sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixture.mix(docs.repartition(7)).collect()), key=repr)
    text = dict(ordered(docs))
    sizes, taken, target = {}, {}, {}
    for r in rows:
        assert r["size"] == len(brute.words(text[r.doc_id])) and r.taken in (0, r["size"], 2 * r["size"])
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    assert [target[s] for s in order] == pytest.approx(mixture.targets([sizes[s] for s in order], [5, 2, 1, 5]))
    for s in order:  # no subset of the source's documents comes nearer, but for rounding
        sums = {0}
        for r in rows:
            if r.source == s:
                sums |= {a + r["size"] for a in sums}
        whole = int(round(target[s])) // max(sizes[s], 1) * sizes[s]
        assert abs(taken[s] - target[s]) <= min(abs(whole + x - target[s]) for x in sums) + 1
    again = mixture.mixed_rows(docs)
    assert again.columns == docs.columns
    times = {r.doc_id: r.times for r in rows}
    counts = {r.doc_id: r["count"] for r in again.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in times.items() if v}
    assert mixture.mix(odd).count() == odd.count() and mixture.mix(empty).count() == 0 and mixture.mixed_rows(empty).count() == 0


def test_targets_reshare():
    assert mixture.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([200, 500 / 3, 250 / 3])
    assert mixture.targets([10, 1000], [5, 2]) == pytest.approx([20, 1495])
    assert mixture.targets([0, 10], [5, 2]) == pytest.approx([0, 15])


def test_knapsack_fits_exactly():
    rnd = np.random.default_rng(3)
    for _ in range(60):
        lengths = rnd.choice(500, rnd.integers(1, 30), replace=False)
        counts = rnd.integers(0, 9, len(lengths))
        total = int((lengths * counts).sum())
        budget = int(rnd.integers(0, total + 1))
        take = mixture.fit(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and abs((lengths * take).sum() - budget) <= 250


@pytest.mark.parametrize("scale", [10, 60_000, 200_000, 3_000_000])
def test_knapsack_takes_long_documents(scale):
    # one document more, above the budget, is nearer than none
    assert mixture.fit(np.array([scale]), np.array([1]), scale * 9 // 10 or 1).tolist() == [1]
    assert mixture.fit(np.array([scale]), np.array([3]), scale * 29 // 10).tolist() == [3]


def test_knapsack_of_few_long_documents_is_near_the_best():
    rnd = random.Random(15)
    assert mixture.fit(np.array([200_000, 290_000]), np.array([1, 1]), 300_000).tolist() == [0, 1]
    for _ in range(60):
        have = [rnd.randrange(10_000, 400_000) for _ in range(9)]
        sizes = np.array(sorted(set(have)))
        budget = rnd.randrange(sum(have))
        got = mixture.fit(sizes, np.array([have.count(x) for x in sizes]), budget)
        sums = np.array([sum(x for k, x in enumerate(have) if m >> k & 1) for m in range(512)])
        floor = np.abs(sums - budget).min()
        assert (got <= 1).all() and abs(int(got @ sizes) - budget) <= floor + 9 * 20  # a unit is under 20 words here


def test_simhash(docs, odd, empty):
    rows = ordered(docs)
    prints = [brute.fingerprint(t) for _, t in rows]
    expected = list(zip([d for d, _ in rows], [f"{p:016x}" for p in prints], brute.components([d for d, _ in rows], prints), strict=True))
    assert by_id(simhash.near_duplicates(docs)) == by_id_rows(expected)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    prints = [brute.fingerprint(t) for _, t in rows]
    expected = list(zip([d for d, _ in rows], [f"{p:016x}" for p in prints], brute.components([d for d, _ in rows], prints), strict=True))
    assert by_id(simhash.near_duplicates(odd)) == by_id_rows(expected)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("exact", [0, 12])
def test_trie_against_all_pairs(exact):
    rnd = np.random.default_rng(exact)
    base = rnd.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = rnd.choice(base, 900)
    for _ in range(6):
        near = near ^ (np.uint64(1) << rnd.integers(0, 64, 900).astype(np.uint64)) * rnd.integers(0, 2, 900).astype(np.uint64)
    key = np.unique(np.concatenate([base, near]))
    label = simhash.trie_links(key, 4, exact)
    want = np.arange(len(key))
    for i in range(len(key)):
        x = key ^ key[i]
        close = np.flatnonzero((np.bitwise_count(x) <= 4) & ((x >> np.uint64(64 - exact) if exact else x * np.uint64(0)) == 0))
        want = simhash._union(want, np.full(len(close), i), close)
    assert (label == want).all()


def test_links_in_small_cells_lose_none(spark):
    rnd = random.Random(2)
    keys = set()
    for _ in range(3):
        b = rnd.getrandbits(64)
        keys |= {b ^ sum(1 << x for x in rnd.sample(range(64), rnd.randrange(5))) for _ in range(60)}
    keys = sorted(keys)
    signed = [k - (1 << 64) if k >> 63 else k for k in keys]
    df = spark.createDataFrame([(n, [k]) for n, k in enumerate(signed)], "node long, prints array<long>")
    whole, cut = ({r.node: r.root for r in simhash.components(simhash.links(df, 4, cell)).collect()} for cell in (1 << 20, 7))
    want = brute.components(list(range(len(keys))), keys)
    assert [cut.get(k, k) for k in range(len(keys))] == want == [whole.get(k, k) for k in range(len(keys))]


def test_near_copies_go_and_others_stay(spark, empty, odd):
    rnd = random.Random(9)
    vocab = [f"{rnd.choice('abcdefgh')}{k}" for k in range(4000)]
    texts = [[rnd.choice(vocab) for _ in range(200)] for _ in range(60)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    for k, t in enumerate(texts[:30]):
        edited = list(t)
        edited[rnd.randrange(200)], edited[rnd.randrange(200)] = "new", "words"
        rows += [(100 + k, " ".join(edited)), (200 + k, " ".join(t))]
    df = spark.createDataFrame([(i, t, "", "", 0, 0, 0, "") for i, t in rows], SCHEMA)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(range(60))
    assert sorted(r.doc_id for r in simhash.keep_one(odd).where("doc_id is not null").collect()).count(5) == 1
    assert simhash.keep_one(empty).count() == 0


def _jaccard(a, b, n=5):
    a, b = ({tuple(t[k : k + n]) for k in range(len(t) - n + 1)} for t in (a, b))
    return len(a & b) / len(a | b)


def _near_kept(spark, texts):
    df = spark.createDataFrame([(i, " ".join(t), "", "", 0, 0, 0, "") for i, t in texts.items()], SCHEMA)
    return {r.doc_id for r in simhash.keep_one(df).collect()}


def test_near_copies_by_block_edits_go(spark):
    rnd = random.Random(11)
    new = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    texts = {k: new(rnd.randrange(150, 1500)) for k in range(240)}
    for k in range(240):
        t = texts[k]
        n = len(t)
        if k % 4 == 0:  # appended
            edited = t + new(int(n * 0.22))
        elif k % 4 == 1:  # cut
            edited = t[: n - int(n * 0.17)]
        elif k % 4 == 2:  # tail replaced
            edited = t[: n - int(n * 0.09)] + new(int(n * 0.09))
        else:  # scattered
            edited = list(t)
            for x in rnd.sample(range(n), n // 50):
                edited[x] = new(1)[0]
        assert _jaccard(t, edited) >= 0.8
        texts[1000 + k] = edited
    assert _near_kept(spark, texts) == set(range(240))


def test_texts_below_the_similarity_stay(spark):
    rnd = random.Random(12)
    new = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    texts = {k: new(400) for k in range(60)}
    for k in range(60):
        texts[1000 + k] = texts[k] + new(rnd.randrange(110, 170))
        assert 0.69 < _jaccard(texts[k], texts[1000 + k]) < 0.79
    assert _near_kept(spark, texts) == set(texts)


def test_near_copies_of_the_same_words_in_another_order(spark, monkeypatch):
    rnd = random.Random(13)
    texts = {}
    for k in range(30):
        a, b = [f"w{rnd.randrange(10**6)}" for _ in range(300)], None
        b = a[::-1]
        # ids: a, its words in another order, copies of both with the first word moved
        texts |= {10 * k: a, 10 * k + 1: b, 10 * k + 2: a[1:] + a[:1], 10 * k + 3: b[1:] + b[:1]}
    assert _near_kept(spark, texts) == {10 * k + x for k in range(30) for x in (0, 1)}


def test_near_copies_by_the_trie_alone(spark, monkeypatch):
    rnd = random.Random(15)
    new = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    texts = {k: new(700) for k in range(30)}
    for k in range(30):
        edited = list(texts[k])
        edited[rnd.randrange(700)] = "edited"
        texts[1000 + k] = edited
    bands = simhash.banded
    monkeypatch.setattr(simhash, "banded", lambda signed: bands(signed).where("false"))
    assert _near_kept(spark, texts) == set(range(30))


@pytest.mark.parametrize("cell", [2, 7])
def test_near_copies_in_small_cells_lose_none(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    rnd = random.Random(14)
    texts = {}
    for k in range(3):
        t = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
        for n in range(25):  # a chain: neighbours are near copies, its ends aren't
            texts[100 * k + n] = t[4 * n : 4 * n + 200]
    kept = set(texts)
    ids = sorted(texts)
    close = {(i, j) for i in ids for j in ids if i < j and _jaccard(texts[i], texts[j]) >= 0.8}
    assert all((i, i + 1) in close for i in ids if i % 100 < 24) and (0, 24) not in close
    assert _near_kept(spark, texts) == {0, 100, 200} < kept


def test_extract_pages(spark):
    page = (
        '<!DOCTYPE html><html><head><title>No</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- c -->'
        '<div class="ad">Buy this now and here</div><article><h1>Head &amp; line</h1><p><b>First</b> part,<br>goes  on<p>wo<i>rd</i> &lt;x&gt;<div class="cookie-notice">We use</div><p>End.'
        '<section id="comments"><p>Nice post friend</p></section></article><aside>side</aside><footer>&copy; foot</footer></body></html>'
    )
    rows = [(k, f"u{k}", page) for k in range(20)] + [(50, None, None), (51, "", ""), (52, "q", "plain words only"), (53, "r", "<p>a > b < c &amp; d</p><form>Send</form>"), (53, "r", "<nav>x</nav>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' as text")
    got = {}
    for r in extract.extract(df).collect():
        got.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    want = "Head & line First part, goes on word <x> End."
    assert all(got[k] == [want] for k in range(20))
    assert got[50] == got[51] == [""] and got[52] == ["plain words only"] and sorted(got[53]) == ["", "a > b < c & d"]
    assert extract.extract(df.limit(0)).count() == 0
    assert extract.extract_text("<div>" * 3000 + "deep " + "</div>" * 3000, extract.Weights()) == "deep"


def test_extract_by_scores_alone(spark):
    w = extract.Weights()
    text = "word " * 200
    for page in (f'<div class="content has-sidebar"><p>{text}</div>', f'<section id="search-article">{text}</section>', f'<body class="with-footer">{text}'):
        assert extract.extract_text(page, w).split() == text.split()
    assert extract.extract_text("<main><article>" + "one " * 90 + "</article><article>" + "two " * 80 + "</article></main>", w).split() == ["one"] * 90 + ["two"] * 80
    page = f'<nav>menu</nav><p>Head<div class="cookie-notice">{"we use " * 50}</div><p>mid<form>send it</form><p>end<section id="comments">{text}</section><aside>x</aside>'
    assert extract.extract_text(page, w) == "Head mid end"
    long = "<p>" + "many words here " * 100_000 + "</p>"
    assert len(extract.extract_text(f"<nav>{long}</nav>{long}", w).split()) == 300_000


def test_region_against_all_regions():
    rnd = random.Random(3)
    for n in [0, 1, *range(2, 40)]:
        v = [rnd.choice([-3, -1, -1, 0, 1, 2]) for _ in range(n)]
        sums = {(a, b): sum(v[a:b]) for a in range(n) for b in range(a + 1, n + 1)}
        a, b = extract.region(v)
        assert sum(v[a:b]) == max([0, *sums.values()])


def test_weights_fitted_on_pages_hold_on_others():
    rnd = random.Random(6)
    say = lambda n: " ".join(f"w{rnd.randrange(999)}" for _ in range(n))

    def page():
        junk = [f'<div class="zz-teaser box">{say(rnd.randrange(5, 90))}</div>' for _ in range(rnd.randrange(1, 6))]
        mid = rnd.randrange(len(junk) + 1)
        body = "".join(f'<div class="box para"><p>{say(rnd.randrange(10, 60))}</p></div>' for _ in range(rnd.randrange(1, 5)))
        return f"<html><body>{''.join(junk[:mid])}<article>{body}</article>{''.join(junk[mid:])}</body></html>"

    pages = [page() for _ in range(180)]
    cases = [extract.labelled(p) for p in pages[120:]]
    assert extract.accuracy(cases, extract.fit(pages[:120])) == 60 and extract.accuracy(cases, extract.Weights()) < 15
    assert extract.fit([]) == extract.fit(["<p>x"]) == extract.Weights()


def test_decontamination(docs, odd, empty, items):
    known = [(r.item_id, r.text) for r in items.collect() if r.item_id is not None]
    got = by_id(decontam.contamination(docs, items.where("item_id is not null")))
    assert got == by_id_rows(brute.contamination(ordered(docs), known))
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert by_id(decontam.contamination(odd, items.where("item_id is not null"))) == by_id_rows(brute.contamination(rows, known))
    unnamed = {r.doc_id: r for r in decontam.contamination(docs, items).collect()}
    loop = next(d for d, t in ordered(docs) if t and t.startswith("loop again"))
    assert unnamed[loop].contaminated and unnamed[loop].n_items == 0
    clean = decontam.keep_clean(docs, items)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, r in unnamed.items() if not r.contaminated}
    assert decontam.contamination(empty, items).count() == 0 and decontam.keep_clean(docs, items.limit(0)).count() == docs.count()


def test_winnowing_keeps_one_gram_of_each_window():
    h = np.random.default_rng(1).integers(0, 1 << 63, 300, dtype=np.uint64)
    first = np.array([0, 120, 125, 300])
    for k in (5, 8, 10):
        kept, least, _ = decontam.winnow(h, first, 10, k)
        at, gram = words.windows(h, first, k)
        want = {}
        for s in [*range(111), *range(125, 291)]:
            inside = np.flatnonzero((at >= s) & (at <= s + 10 - k))
            best = inside[len(inside) - 1 - int(np.argmin(gram[inside][::-1]))]
            want[int(at[best])] = gram[best]
        assert dict(zip(kept.tolist(), least, strict=True)) == want and (k == 10) == (len(kept) == 277)


def test_hits_are_extended(spark):
    rnd = random.Random(4)
    say = lambda n: [rnd.choice("abc") for _ in range(n)]
    item = say(40)
    texts = [say(9) + item[a : a + n] + say(9) for a in range(0, 30, 3) for n in range(8, 14)] + [item * 3, item[:9], item[:10], say(2000)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    known = [(1, " ".join(item)), (2, " ".join(item[5:30])), (3, "a b"), (4, " ".join(say(12))), (5, " ".join(item))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k in (4, 8, 10):
        got = decontam.contamination(df, spark.createDataFrame(known, "item_id long, text string"), k=k)
        assert by_id(got) == by_id_rows(brute.contamination(rows, known))


def test_line_runs(docs, odd, empty):
    got = by_id(linededup.remove_repeats(docs))
    assert got == by_id_rows(brute.lines(ordered(docs)))
    assert linededup.remove_repeats(odd).count() == odd.count()
    assert linededup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("head, block", [(8, 64), (2, 3)])
def test_line_runs_of_many_rounds(spark, monkeypatch, head, block):
    monkeypatch.setattr(linededup, "HEAD", head)
    monkeypatch.setattr(linededup, "BLOCK", block)
    rnd = random.Random(head)
    long = [rnd.choice("abcdefgh") * 3 + str(rnd.randrange(40)) for _ in range(300)]
    texts = [long, long[40:290], ["x"] * 150, ["x"] * 70 + ["y"], long[:120] + ["z"] + long[121:], ["own 1", *long[200:], "own 2"], [], ["x", "own 3", "x"]]
    texts += [long[a : a + rnd.randrange(1, 40)] + rnd.sample(long, 5) for a in range(0, 250, 25)] + [texts[1]] * 3
    rows = [(k, "\n".join(t)) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(i, x, "", "", 0, 0, 0, "") for i, x in rows], SCHEMA).repartition(3)
    got = linededup.remove_repeats(df, texts=True)
    assert by_id(got.drop("kept_text")) == by_id_rows(brute.lines(rows))
    assert all(brute.sha(r.kept_text) == r.kept_sha256 for r in got.collect())


def test_long_lines_that_repeat_alone_go(spark):
    line = " ".join(f"w{k}" for k in range(60))
    short = " ".join(f"w{k}" for k in range(50))
    texts = {1: f"a\n{line}\nb", 2: line, 3: line, 4: f"c\n{line}\nd", 5: short, 6: short, 7: f"{line}\ne\n{short}"}
    df = spark.createDataFrame([(i, x, "", "", 0, 0, 0, "") for i, x in texts.items()], SCHEMA)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in linededup.remove_repeats(df, long=50).collect()}
    kept = {**texts, 2: "", 3: "", 4: "c\nd", 7: f"e\n{short}"}
    assert got == {i: (texts[i].count("\n") + 1, (i in (2, 3, 4, 7)) + 0, brute.sha(kept[i])) for i in texts}


def test_spans(docs, odd, empty):
    assert by_id(spans.remove_repeats(docs)) == by_id_rows(brute.spans(ordered(docs)))
    out = spans.remove_repeats(odd, texts=True).where("doc_id = 5").collect()
    assert sorted(r.n_removed for r in out) == [0, 120, 120] and all(brute.sha(r.kept_text) == r.kept_sha256 for r in out)
    assert spans.remove_repeats(empty).count() == 0
    values = np.unique(np.random.default_rng(0).integers(0, 1 << 40, 5000, dtype=np.uint64))
    assert (spans.unpack(spans.pack(values)) == values).all() and len(spans.unpack(spans.pack(values[:0]))) == 0


def test_quality(docs, odd, empty):
    got = {r.doc_id: r for r in quality.measure(docs).collect()}
    for d, t in ordered(docs):
        n = brute.base_counts(t)
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r.kept and r.base_failed)
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if r.kept}
    assert quality.measure(odd).count() == odd.count() and quality.keep(empty).count() == 0


def test_tokens(docs, odd, empty):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(PATH)
    for df in (docs, odd):
        rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0))
        got = tokens.digest(tokens.write_tokens(df, PATH)).collect()
        coded = {t: [*e.ids, 1] for (_, t), e in zip(rows, model.encode_batch([t for _, t in rows], add_special_tokens=False), strict=True)}
        want = sorted(((d, len(coded[t]), zlib.crc32(np.array(coded[t], "<u4").tobytes())) for d, t in rows), key=repr)
        assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == want
        total = 0
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == total
            total += r.n_tokens
        ids = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
        assert ids == sorted(ids)
    assert tokens.digest(tokens.write_tokens(empty, PATH)).count() == 0


def test_table_of_words_grows():
    table, rnd = tokens._Table(4), np.random.default_rng(5)
    h, other = (rnd.integers(1, 1 << 64, 5000, dtype=np.uint64) | np.uint64(1) for _ in range(2))
    table.add(h[:13], other[:13], np.arange(13))
    assert table.bits > 4  # a full table would never end
    table.add(h[13:], other[13:], np.arange(13, 5000))
    assert table.n == 5000 <= 3 << table.bits - 2
    assert (table.find(h, other) == np.arange(5000)).all() and (table.find(h + np.uint64(2), other) == -1).all()


def test_segments_decode_at_random(texts):
    e = tokens.Encoder(PATH)
    plain = [t or "" for t in texts] * 3
    flat, sizes = e.column(pa.array(plain), 1)
    raw = tokens.write_segment(np.arange(len(plain)), np.zeros(len(plain), bool), flat, sizes, 1)
    s = tokens.Segment(raw)
    assert len(s.rules) > 0 and (s.ids() == flat).all() and len(s.symbols) < len(flat)
    begin = np.cumsum(sizes) - sizes
    rnd = random.Random(4)
    for _ in range(200):
        k = rnd.randrange(len(plain))
        a = rnd.randrange(sizes[k] + 1)
        b = rnd.randrange(a, sizes[k] + 3)
        assert (s.document(k, a, b) == flat[begin[k] : begin[k] + sizes[k]][a:b]).all()
    assert tokens.expand(np.arange(len(s.terminals), len(s.terminals) + len(s.rules)), s.rules, len(s.terminals)).size == s.lengths.sum()


def test_tokenizer_words_equal_whole_texts():
    from tokenizers import Tokenizer

    rnd = random.Random(5)
    signs = [*"aBcßÜé.,'!|<>s0९́İǅΣς日本  \t\n zt", "<|endoftext|>", "'s", "n't", "<|", "J̌", "x.", "É", "é"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(40))) for _ in range(3000)]
    flat, sizes = tokens.Encoder(PATH).column(pa.array(texts), 1)
    at = 0
    for n, e in zip(sizes.tolist(), Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False), strict=True):
        assert flat[at : at + n].tolist() == [*e.ids, 1]
        at += n


def test_tokenizer_learns_a_word_once_whatever_signs_touch_it(monkeypatch):
    from tokenizers import Tokenizer

    e, seen = tokens.Encoder(PATH), []
    learn = e._learn
    monkeypatch.setattr(e, "_learn", lambda plain: (seen.extend(plain), learn(plain))[1])
    forms = ("W W. W, W!! W### (W) [W]: W% W's 7W W7 *W* W;W", "W?\nW/W&&& \"W\"", "W")
    texts = [x.replace("W", w) for w in ("word", "señaé", "Wörd") for x in forms]
    flat, sizes = e.column(pa.array(texts), 1)
    want = [[*x.ids, 1] for x in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == [len(x) for x in want] and flat.tolist() == sum(want, [])
    assert [w for w in seen if b"word" in w] == [b"word"] and len(seen) == len(set(seen))


def test_tokenizer_parts_at_signs_equal_whole_texts():
    from tokenizers import Tokenizer

    rnd = random.Random(6)
    marks = [chr(c) for c in (0x300, 0x301, 0x307, 0x30C, 0x327, 0x338, 0x85, 0xA0, 0x200D, 0x2028, 0xFEFF, 0x00, 0x1C, 0x7F)]
    latin = [chr(c) for c in range(0xC0, 0x180)]
    words_ = ["J̌", "I̊", "Σ", "é", "日", "०", "²", "'S", "'Re", "'ll", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "KK", "ing", "The"]
    signs = [*map(chr, range(0x21, 0x7F)), *"'|<> \n" * 3, *marks, *latin[::3], *words_]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(30))) for _ in range(6000)]
    texts += [f"{a}{b}{c}" for a in (*latin, "J", "x") for b in ("!", "'", "'s", chr(0x30C), "7", "|") for c in ("a", chr(0x338), "#")]
    flat, sizes = tokens.Encoder(PATH).column(pa.array(texts), 1)
    at = 0
    for x, n, e in zip(texts, sizes.tolist(), Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False), strict=True):
        assert flat[at : at + n].tolist() == [*e.ids, 1], x
        at += n


def test_warc_audit(spark):
    rows = [(k, f"u{k}", "x" * k if k % 5 else None) for k in range(300)] + [(7, "u7", "twice")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    from pyspark.sql import functions as F

    make = lambda df: df.select("page_id", warc.record(F.col("url"), F.col("page_id"), F.col("html")).alias("record"))
    hurt = pages.withColumn("html", F.when(F.col("page_id").isin(3, 44, 299), F.concat(F.lit("~"), F.substring("html", 2, 999))).otherwise(F.col("html")))
    got = warc.fixity(make(pages), make(hurt), ["page_id"])
    assert sorted(r.page_id for r in got.where("damaged").collect()) == [3, 44, 299]
    assert got.count() == 301 and warc.fixity(make(pages.limit(0)), make(pages.limit(0)), ["page_id"]).count() == 0
    assert warc.fixity(make(pages), make(pages), ["page_id"]).where("damaged").count() == 0
    assert warc.fixity(make(pages), make(pages.where("page_id < 200")), ["page_id"]).where("damaged").count() == 100
    raw = b"".join(bytes(r.record) if isinstance(r.record, bytearray) else r.record.encode() for r in make(pages.where("page_id < 20")).orderBy("page_id").collect())
    parsed = list(warc.parse(raw))
    assert sum(r[1] for r in parsed) == len(raw) and parsed[1][3] == b"x" and all(r[4] for r in parsed)
    named = pages.select(F.col("page_id").alias("node"), F.col("page_id").alias("hash"), "html", F.lit(1).alias("start"))
    got = warc.fixity(named.withColumnRenamed("html", "record"), named.withColumnRenamed("html", "record"), ["node", "hash"])
    assert got.columns == ["record_node", "record_hash", "node", "start", "end", "hash", "replica_hash", "damaged"] and got.count() == 301


def test_read_warc(spark, tmp_path):
    import gzip

    one = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: http://a\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(one * 2)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one))
    got = warc.read_warc(spark, f"file://{tmp_path}").collect()
    assert len(got) == 3 and {(r.uri, bytes(r.payload)) for r in got} == {("http://a", b"abc")} and all(r.whole for r in got)
    big = [one.replace(b"Length: 3", f"Length: {n}".encode()).replace(b"abc", b"z" * n) for n in (3, 2_500_000, 7)]
    for raw in (b"".join(big), b"".join(map(gzip.compress, big)), b"junk" + gzip.compress(b"")[:0] + b"".join(big)):
        parsed = list(warc.parse(raw))
        assert [len(r[3]) for r in parsed] == [3, 2_500_000, 7] and all(r[4] for r in parsed)
    cut = list(warc.parse(one + one.replace(b"Length: 3", b"Length: 30")))
    assert [r[4] for r in cut] == [True, False] and list(warc.parse(b"")) == [] and not list(warc.parse(one[:40]))[0][4]


def test_clashing_names(spark, docs, items):
    odd = docs
    for c in ("_id", "_source", "_size", "_hash", "_range", "_times", "_copy", "_row", "gone", "_gone", "bad_id", "bad_hash", "_bad_id", "uid", "id", "kin", "doc", "pos", "cut", "tie", "_value"):
        odd = odd.selectExpr("*", f"'{c}' as {c}")
    for one in (mixture.mixed_rows, simhash.keep_one, quality.keep, lambda d: decontam.keep_clean(d, items)):
        got, want = one(odd), one(docs)
        assert got.columns == odd.columns and sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in want.collect())
    for one in (shards.shard, mixture.mix, simhash.near_duplicates, quality.measure, spans.remove_repeats, linededup.remove_repeats, lambda d: decontam.contamination(d, items), lambda d: tokens.digest(tokens.write_tokens(d, PATH))):
        assert one(odd).count() == docs.count()
