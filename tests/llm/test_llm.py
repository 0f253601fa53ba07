"""The training-data operators against brute force, libraries, and hard rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tests.llm import brute

import public_tokenizers
from lorewright.llm import decontaminate, exact_dedup, html_text, language_model, near_dedup, quality, sentencepieces, suffix_dedup, textkit, token_files, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, h string, ah int, tile int, root string, part int"
HARD = [
    (1, None), (2, ""), (3, "   "), (4, "one"), (5, "One"), (6, "a b c d"), (7, "!!!"), (8, "Ünïcode ß 日本語 text with words"), (9, "a" * 700),
    (10, "x y z " * 400), (11, "x y z " * 400), (11, "x y z " * 400), (None, "null id"), (None, None), (12, "word " * 30000), (13, "line one\nline two\tend\r\n"), (14, "<|endoftext|> ▁ a  b c"),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def frame(spark, rows):
    """The rows with columns whose names clash with those that operators use inside, full of nulls."""
    return spark.createDataFrame([(d, t, None, None, None, None, None, None, None, None, None) for d, t in rows], SCHEMA)


def varied(seed, n=60, words=40):
    """Random texts with exact and near copies, and a shared passage."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(500)]
    text = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage, out = text(70), []
    for d in range(n):
        kind = r.random()
        if out and kind < 0.2:
            own = r.choice(out)[1]
        elif out and kind < 0.5:
            w = r.choice(out)[1].split(" ")
            for _ in range(r.randint(1, 4)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            own = " ".join(w)
        elif kind < 0.7:
            own = f"{text(r.randint(0, words))} {passage} {text(r.randint(0, words))}"
        else:
            own = text(r.randint(1, 4 * words))
        out.append((d, own.upper() if r.random() < 0.1 else own))
    return out


def checked_suffixes(spark, rows):
    got = sorted(suffix_dedup.suffix_dedup(frame(spark, rows)).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.kept_sha256))
    want = []
    for d, b, marks in brute.removed(rows):
        rest = bytes(x for x, m in zip(b, marks) if not m)
        want.append((d, len(b), sum(marks), sum(m and not (i and marks[i - 1]) for i, m in enumerate(marks)), hashlib.sha256(rest).hexdigest()))
    assert [tuple(r)[:5] for r in got] == sorted(want, key=lambda r: (r[0] is not None, r[0] or 0, r[4])) and all(r.repeats == (r.n_removed > 0) for r in got)


def test_suffix_dedup(spark):
    checked_suffixes(spark, varied(1))
    checked_suffixes(spark, [(d, t if t is None or len(t) < 3000 else t[:3000]) for d, t in HARD])


def test_suffix_dedup_crowded(spark, monkeypatch):
    rows = varied(2)
    monkeypatch.setattr(suffix_dedup, "CROWD", 2)
    checked_suffixes(spark, rows)


def test_suffix_order_and_fallback():
    r = random.Random(3)
    text = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(300)]
    group = np.sort(np.array([r.randrange(9) for _ in text]))
    data, offsets = textkit.flat(pa.array(text, pa.large_binary()).view(pa.large_string()))
    s = suffix_dedup.Suffixes(data, offsets)
    order, shared = s.sorted(group)
    assert s.verified(order, shared)
    want, common = s.by_bytes(group)
    assert [text[i] for i in order] == [text[i] for i in want] and shared.tolist() == common.tolist()
    wrong = shared.copy()
    wrong[np.flatnonzero(shared > 0)[0]] -= 1
    assert not s.verified(order, wrong)


def exact_expected(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault((t or "").translate(brute.LOWER), []).append(d)
    key = lambda d: (d is not None, d or 0)
    return sorted(((d, max(g, key=key), len(g), d == max(g, key=key), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g), key=lambda r: (key(r[0]), r[4]))


@pytest.mark.parametrize("tile", [4 << 20, 300])
def test_exact_dedup(spark, monkeypatch, tile):
    monkeypatch.setattr(exact_dedup, "TILE_BYTES", tile)
    rows = HARD + [(100 + k, ("Many copies of one text", "many copies of one TEXT")[k % 2]) for k in range(60)]
    got = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: ((r[0] is not None, r[0] or 0), r[4])) == exact_expected(rows)
    kept = exact_dedup.keep_one(frame(spark, rows)).collect()
    assert sorted((r.text or "").translate(brute.LOWER) for r in kept) == sorted({(t or "").translate(brute.LOWER) for _, t in rows})


def test_exact_dedup_in_many_rounds(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "_share", lambda: F.lit(2))
    rows = [(k, "one text") for k in range(11)] + [(k, "OTHER text") for k in range(20, 23)]
    got = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    assert sorted(tuple(r) for r in got) == exact_expected(rows)


def test_names_are_free_of_collisions():
    text = [b"", b"\0", b"\0\0", b"a" * 8, b"a" * 8 + b"\0", b"ab" * 50, b"ab" * 50, b"ba" * 50]
    got = exact_dedup.names(*textkit.flat(pa.array(text, pa.large_binary()).view(pa.large_string()))).tolist()
    assert [[a == b for b in got] for a in got] == [[a == b for b in text] for a in text]


@pytest.mark.parametrize("small", [False, True])
def test_near_dedup(spark, monkeypatch, small):
    if small:  # tiles, hubs, the rest against all, and crowded buckets
        for name, value in (("TILE", 4), ("HUBS", 1), ("CAP", 3)):
            monkeypatch.setattr(near_dedup, name, value)
    rows = varied(4, 120)
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(frame(spark, rows)).collect()}
    want = brute.near_classes(rows)
    assert sum(got[d] != want[d] for d in want) == 0


@pytest.mark.parametrize("cap", [1, 2, 20])
def test_near_dedup_hot_buckets(spark, monkeypatch, cap):
    """Every pair that meets in a bucket stays in one component, whether the bucket is hot or crowded or not."""
    r = np.random.default_rng(5)
    f = r.integers(0, 1 << 64, (500, 2), dtype=np.uint64)

    def flipped(rows, bits):
        out = rows.copy()
        for row in out:
            for place in r.permutation(128)[:bits]:
                row[place // 64] ^= np.uint64(1 << int(place % 64))
        return out

    f = np.concatenate([f, flipped(f, 28), flipped(f[:1].repeat(60, 0), 6), flipped(f[:1].repeat(40, 0), 27)])
    reps = [(k, *(int(x) for x in f[k].view(np.int64)), 100) for k in range(len(f))]
    monkeypatch.setattr(near_dedup, "CAP", cap)
    got = {e.node: e.root for e in textkit.components(near_dedup.candidates(spark.createDataFrame(reps, "id long, f1 long, f2 long, size long"))).collect()}
    near = np.bitwise_count(f[:, None] ^ f[None]).sum(2) <= near_dedup.RADIUS
    met = np.zeros_like(near)
    for t in range(near_dedup.TABLES):
        key = near_dedup._sampled(f, near_dedup._SAMPLES[t, : near_dedup.BITS])
        met |= key[:, None] == key[None]
    a, b = np.nonzero(near & met & ~np.eye(len(f), dtype=bool))
    assert len(a) > 100 and all(got.get(int(x), int(x)) == got.get(int(y), int(y)) for x, y in zip(a, b))


def test_near_dedup_hard_rows(spark):
    got = near_dedup.near_dedup(frame(spark, HARD)).collect()
    assert len(got) == len(HARD)
    of = {r.doc_id: r for r in got if r.doc_id is not None}
    assert of[4].class_id == of[5].class_id == 4 and of[10].class_id == of[11].class_id == 10 and all(of[d].class_size == 1 for d in (1, 2, 3, 7))


def test_linking_needs_no_pair_left_out():
    r = np.random.default_rng(5)
    for _ in range(20):
        sets = [np.unique(r.integers(0, 14, r.integers(1, 12))) for _ in range(40)]
        sizes = np.array([len(s) for s in sets])
        a, b = near_dedup.linked(np.concatenate(sets), np.cumsum(sizes) - sizes, sizes)
        got = textkit.joined(40, a, b)
        pairs = [(i, j) for i in range(40) for j in range(i) if 10 * len(np.intersect1d(sets[i], sets[j])) >= 8 * len(np.union1d(sets[i], sets[j]))]
        want = textkit.joined(40, np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int))
        assert got.tolist() == want.tolist()


def test_decontamination(spark):
    rows = varied(6, 40) + [(1000 + d, t) for d, t in HARD[:9]]
    w = rows[3][1].split() + rows[5][1].split()
    items = [(0, " ".join(w[4:24])), (1, "one"), (2, None), (3, ""), (4, " ".join(w[10:16] + ["zzz"] + w[16:40])), (5, "a b c"), (6, "never seen " * 9), (7, rows[8][1]), (7, rows[8][1])]
    table = spark.createDataFrame(items, "item_id int, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(frame(spark, rows), table).collect()}
    assert got == brute.leaks(rows, items) and got
    kept = {r.doc_id for r in decontaminate.keep_clean(frame(spark, rows), table).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in got}


def test_decontamination_in_slices(spark, monkeypatch):
    rows = varied(7, 30)
    items = [(k, t) for k, (_, t) in enumerate(varied(7, 12))]
    monkeypatch.setattr(decontaminate, "SLICE_ITEMS", 5)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(frame(spark, rows), spark.createDataFrame(items, "item_id int, text string")).collect()}
    assert got == brute.leaks(rows, items)


def random_texts(seed, n=3000):
    r = random.Random(seed)
    signs = "ab Z  \n\n.,'s't9é ñµº٣γ́日\t\xa0▁\x85'll​|€😀"
    return ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_sentencepiece(spark, rows):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    every = rows + HARD[:-1] + [(10_000 + k, t) for k, t in enumerate(random_texts(8))]
    got = sorted(tuple(r) for r in sentencepieces.encoded(frame(spark, [(d or 0, t) for d, t in every]), path).collect())
    want = []
    for d, t in every:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((d or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)


def test_token_files(spark, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    every = rows + [(20_000 + (d or 0), t) for d, t in HARD] + [(30_000 + k, t) for k, t in enumerate(random_texts(9))] + [(None, "null id")]
    got = sorted((tuple(r) for r in token_files.round_trip(frame(spark, every), path).collect()), key=lambda r: r[1])
    start, want = 0, []
    for d, t in sorted(every, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_token_file_seeks_and_sees_damage(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 10)
    w = token_files.Writer(str(tmp_path), "x.zst")
    ids = [np.arange(k, dtype="<u4").tobytes() for k in range(12)]
    for k, i in enumerate(ids):
        w.add(None if k == 3 else k, i)
    w.close()
    system, folder = token_files.opened(str(tmp_path))
    reader = token_files.Reader(system, f"{folder}/x.zst")
    assert len(reader.entries) > 3
    assert [reader.document(k) for k in (11, 0, 3)] == [(11, ids[11]), (0, ids[0]), (None, ids[3])]
    raw = bytearray((tmp_path / "x.zst").read_bytes())
    raw[int(reader.starts[1]) + 20] ^= 1
    (tmp_path / "x.zst").write_bytes(raw)
    bad = token_files.Reader(system, f"{folder}/x.zst")
    list(bad.frame(0))
    with pytest.raises(Exception):  # noqa: B017
        list(bad.frame(1))


def test_language_model(spark, rows):
    every = rows[:150] + [(d, t if t is None or len(t) < 5000 else t[:5000]) for d, t in [(10_000 + d, t) for d, t in HARD if d not in (None, 11)]]
    want, total = brute.kneser_ney(every)
    got = {r.doc_id: r for r in language_model.score(frame(spark, every)).collect()}
    assert len(got) == len(every)
    for d, (out, n, known, base, own) in want.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(own, rel=1e-9)


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = labels.select("doc_id", "toxic").join(docs.select("doc_id", "lang"), "doc_id")
    r = toxicity.score(docs, labels).join(known, "doc_id").where("held_out").toPandas()
    pos, neg = r[r.toxic == 1], r[r.toxic == 0]
    assert np.mean([(p > n) + 0.5 * (p == n) for p in pos.score for n in neg.score]) > 0.95
    assert ((0 <= r.score) & (r.score <= 1)).all() and (r.predicted == (r.score >= 0.3)).all()
    assert (pos.groupby("lang").predicted.mean() >= 0.85).all() and pos.lang.nunique() == 4 and neg.predicted.mean() <= 0.02
    model = toxicity.fit(docs, labels)
    texts = ["you are a stupid worthless idiot, you moron", "The house stands by the river.", "", "you st*pid m0ron"]
    out = next(toxicity.scorer(model)(iter([pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4], "held_out": [False] * 4, "text": texts})])))
    assert out.column("predicted").to_pylist()[:3] == [1, 0, 0]


def test_toxicity_hard_rows(spark):
    labels = spark.createDataFrame([(d, k % 2, k % 2, None) for k, (d, _) in enumerate(HARD)] + [(1, 0, 1, None), (None, 1, 1, None), (99, None, None, None)], "doc_id long, quality int, toxic int, text string")
    got = toxicity.score(frame(spark, HARD), labels).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((d is None, d or 0) for d, _ in HARD)
    assert all(0 <= r.score <= 1 for r in got) and not any(r.held_out for r in got if r.doc_id is None)
    kept = toxicity.keep_clean(frame(spark, HARD), labels)
    assert kept.columns == frame(spark, HARD).columns and kept.count() == sum(1 - r.predicted for r in got)


def test_lexicon_is_learned_without_the_fold(spark):
    """Against plain counting: terms of each fold's lexicon and their weights."""
    import math

    r = random.Random(12)
    rows = [(int(k % 5 == 0), ("vilething " if k % 5 == 0 and k % 10 else "") + " ".join(f"w{r.randrange(40)}" for _ in range(12)), k % toxicity.FOLDS) for k in range(300)]
    got = toxicity.lexicons(spark.createDataFrame(rows, "toxic int, text string, fold int"))
    for out in range(toxicity.FOLDS + 1):
        own = [(t, x) for t, x, f in rows if f != out]
        want = {}
        sets = [(t, {w for word in x.split() for w in {word, *(word[:k] for k in toxicity.PREFIXES if len(word) > k)}}) for t, x in own]
        n = [sum(t == k for t, _ in sets) for k in (0, 1)]
        for w in {w for _, s in sets for w in s}:
            c = [sum(w in s for t, s in sets if t == k) for k in (0, 1)]
            odds = math.log((c[1] + 0.5) / (n[1] + 1)) - math.log((c[0] + 0.5) / (n[0] + 1)) - 1.5 * math.sqrt(1 / (c[1] + 0.5) + 1 / (c[0] + 0.5))
            if c[1] >= toxicity.LEAST and odds >= toxicity.MINIMUM:
                want[w] = odds
        names = textkit.words(*textkit.flat(pa.array(sorted(want))))[0]
        expected = dict(zip(names.tolist(), (want[w] for w in sorted(want))))
        assert dict(zip(got[out][0].tolist(), got[out][1].tolist())) == pytest.approx(expected) and "vilething" in want


def test_disguised_words():
    assert toxicity._revealed(b"m0ron") and toxicity._revealed(b"st*pid") and toxicity._revealed(b"i.d.i.o.t") and not toxicity._revealed(b"river-side")
    x = toxicity.features(pa.array(["You IDIOT!", None, "", "plain words here"]))
    at = toxicity.NAMES.index
    assert x[0, at("lexicon_count")] == 1 and x[0, at("near_second_person")] == 1 and x[0, at("second_person")] == 0.5 and x[1].tolist() == x[2].tolist() and x[3, at("lexicon_count")] == 0
    drawn = toxicity.features(pa.array(["what an idiooot", "m0ron he is", "a good book", "x" * 60 + "1" + "y" * 60]))
    assert drawn[:, at("disguised_count")].tolist() == [1, 1, 0, 0] and drawn[0, at("disguised_density")] > 0
    term = textkit.words(*textkit.flat(pa.array(["vile"])))[0]
    x = toxicity.features(pa.array(["you vileness", "vile", "nice"]), (term, np.array([2.0])))
    assert x[:, at("learned_count")].tolist() == [1, 1, 0] and x[:, at("learned_near_second_person")].tolist() == [1, 0, 0] and x[0, at("learned_top")] == 2


def test_toxicity_without_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score(frame(spark, [(1, "you idiot"), (2, "fine"), (3, None)]), empty).collect()}
    assert got == {1: 1, 2: 0, 3: 0}


def test_quality(spark):
    """Fitted on labels of even ids, judged on odd ones."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    r = quality.score(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1").select("doc_id", "quality"), "doc_id").toPandas()
    assert (r.keep == (r.quality == 1)).mean() > 0.9 and len(r) > 100
    for texts in (HARD, [(d, t) for d, t in HARD if t is None]):
        hard = quality.score(frame(spark, texts), labels.limit(0)).collect()
        assert len(hard) == len(texts) and all(0 <= x.score <= 1 for x in hard)


def test_quality_posteriors(spark):
    """Host and path posteriors against plain arithmetic: a null host, hosts of one document, ties and repeated rows."""
    import math

    r = random.Random(21)
    rows = []
    for k in range(160):
        host = [None, "a", "b", "lone"][0 if k % 9 == 0 else 3 if k == 1 else 1 + k % 2]
        bad = r.random() < (0.8 if host == "b" else 0.2)
        rows.append((k // 2 if k % 20 == 3 else k, "| x | " * 20 if bad else "Plain words follow here, and more. " * 3, ["en", "de", None][k % 3], host))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = quality.score(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    rule = quality.Rule()(quality.features(pa.array([t for _, t, _, _ in rows])))
    p = [1 / (1 + math.exp(-x)) for x in rule]
    mean = sum(p) / len(p)
    sums = lambda key: {g: (sum(q for q, x in zip(p, rows) if key(x) == g), sum(key(x) == g for x in rows)) for g in {key(x) for x in rows}}

    def strength(groups, prior):
        n = sum(m for _, m in groups.values())
        spread = sum(m * ((t / m - prior(g)) ** 2 - prior(g) * (1 - prior(g)) / m) for g, (t, m) in groups.items()) / n
        centre = sum(m * prior(g) for g, (_, m) in groups.items()) / n
        return 1e4 if spread <= 1e-6 else min(max(centre * (1 - centre) / spread - 1, 1.0), 1e4)

    hosts, paths = sums(lambda x: x[3]), sums(lambda x: (x[3], x[2]))
    k = strength(hosts, lambda g: mean)
    host = {g: (t + k * mean) / (m + k) for g, (t, m) in hosts.items()}
    q = strength(paths, lambda g: host[g[0]])
    want = []
    for own, x, logit in zip(p, rows, rule):
        t, m = paths[x[3], x[2]]
        others = min(max((t - own + q * host[x[3]]) / (m - 1 + q), 1e-3), 1 - 1e-3)
        final = 1 / (1 + math.exp(-(logit + quality.WEIGHT * (math.log(others / (1 - others)) - math.log(mean / (1 - mean))))))
        want.append((x[0], own, host[x[3]], others, final))
    key = lambda v: (v[0], round(v[1], 4), round(v[2], 4), round(v[3], 4))
    for g, w in zip(sorted(([x.doc_id, x.doc_score, x.host_score, x.path_score, x.score] for x in got), key=key), sorted(want, key=key)):
        assert g == pytest.approx(list(w), abs=2e-6)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script><style>p{}</style></head><body>
<nav><ul><li><a href=/>Home</a></ul></nav><div class="ad">Buy this now, please.</div><div id="cookie-notice">We use cookies.</div>
<article><header>byline</header><h1>A  title &amp; more</h1><p>First <b>bold</b> text.<p>Second,<br>broken &lt;line&gt;.<form><input><label>mail</label></form>
<aside>aside</aside><ul><li>one<li>two</ul><section class="comments"><p>A reader says something long, really, very long.</p></section></article>
<div class=sidebar>side</div><footer>&copy; x</footer>"""


def test_html():
    assert html_text.extract(PAGE) == "A title & more\n\nFirst bold text.\n\nSecond, broken <line>.\n\none\n\ntwo"
    long = "Plain words, and more of them, follow each other here. " * 4
    page = f"<body><div><a href=x>Menu</a> <a href=y>Other</a></div><div><p>{long}</p><p>Short.</p></div><div><span>tiny</span></div></body>"
    assert html_text.extract(page) == f"{long.strip()}\n\nShort."
    assert html_text.extract("") == "" and html_text.extract("<p>") == "" and html_text.extract("just text") == "just text" and html_text.extract("<article><p>cut <b>of") == "cut of"


def test_html_several_elements_hold_the_text():
    long = "Plain words, and more of them, follow each other here. " * 12
    menu = "<div><a href=x>One</a> <a href=y>Two</a></div>"
    page = f"<body>{menu}<div><section><p>{long}</p></section><section><p>Short, but part of it.</p><p><a href=z>A linked line</a></p></section></div><div><span>tiny</span></div></body>"
    assert html_text.extract(page) == f"{long.strip()}\n\nShort, but part of it.\n\nA linked line"
    page = f"<body>{menu}<main><h1>Name</h1><div><p>{long}</p><p>{long}</p></div></main><article><span>Teaser</span></article></body>"
    assert html_text.extract(page) == f"Name\n\n{long.strip()}\n\n{long.strip()}"
    page = f"<body><div><p>{long}</p></div><article><p>Teaser card, see more.</p></article></body>"
    assert long.strip() in html_text.extract(page)
    page = f"<body><article><p>{long}</p></article><article><p>{long}</p></article></body>"
    assert html_text.extract(page).count(long.strip()) == 2


def test_html_needs_no_article(spark):
    """Real pages give the same text when article and main are plain divisions."""
    import re

    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    plain = [re.sub(r"(?i)(</?)(?:article|main)(?=[\s>])", r"\1div", h) for h in pages]
    assert all(html_text.extract(h) for h in pages) and sum(html_text.extract(a) != html_text.extract(b) for a, b in zip(pages, plain)) == 0


def test_html_shapes():
    long = "Plain words, and more of them, follow each other here. " * 6
    text = long.strip()
    menu = "<ul><li><a href=a>One</a><li><a href=b>Two</a><li><a href=c>Three</a></ul>"
    assert html_text.extract(f"<body>{menu}<table><tr><td><p>{long}</p><p>{long}</p></td></tr></table>{menu}</body>") == f"{text}\n\n{text}"
    assert html_text.extract(f"<body><div id=x>{menu}</div><div><h2>Head</h2><p>{long}</p></div><div class=comments><p>{long * 5}</p></div></body>") == f"Head\n\n{text}"
    assert html_text.extract(f"<body><div><p>{long}</p><blockquote>{long}</blockquote><pre>a  b\n c</pre></div><div class='related'><p>{long}</p></div></body>") == f"{text}\n\n{text}\n\na b c"
    many = "".join(f"<p>Part {k}. {long}</p>" for k in range(3000))
    assert html_text.extract(f"<body>{menu}<div>{many}</div></body>").count("\n\n") == 2999


def test_html_table(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "<p>x</p>"), (3, "w", "<div>" * 3000 + "deep")]
    got = html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got) and [r.text for r in got if r.page_id == 2] == [""]


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels, items, pages = (spark.read.parquet(f"{SF}/{t}.parquet").limit(0) for t in ("labels", "benchmark", "pages"))
    outs = [suffix_dedup.suffix_dedup(none), exact_dedup.exact_dedup(none), quality.score(none, labels), decontaminate.matches(none, items), decontaminate.matches(docs, items), near_dedup.near_dedup(none)]
    outs += [sentencepieces.encoded(none, public_tokenizers.path("piece_bpe_32k.model")), toxicity.score(none, labels), language_model.score(none), html_text.extracted(pages), token_files.round_trip(none, public_tokenizers.path("byte_bpe_50k.json"))]
    assert [o.count() for o in outs] == [0] * len(outs)


def test_hard_ids_and_repeats(spark, rows):
    """Null ids, repeated rows, long texts and clashing columns where other tests leave them out."""
    long = [(21, "one two three four five six " * 6000), (22, None), (None, "one two three four five six seven"), (None, None)]
    every = rows[:40] + rows[:3] + long
    model = language_model.score(frame(spark, every)).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0) for r in model)) == sorted((d is None, d or 0) for d, _ in every)
    assert all(r.held_out is not None for r in model) and len({r.train_tokens for r in model}) == 1
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = sentencepieces.encoded(frame(spark, long), path).collect()
    assert [r.doc_id for r in got].count(None) == 2 and min(r.n_tokens for r in got) == 2
    items = spark.createDataFrame([(1, "one two three four five six seven"), (None, "one two three four five six seven"), (2, "one two three four five six " * 5)], "item_id int, text string")
    leaks = {(r.doc_id, r.item_id) for r in decontaminate.matches(frame(spark, long + long), items).collect()}
    assert {(None, 1), (None, None), (21, 2)} <= leaks and not any(d == 22 for d, _ in leaks)
    kept = decontaminate.keep_clean(frame(spark, long + long), items).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in kept if r.text) == [] and len(kept) == 4  # both null texts, twice


def test_pipeline_stages_on_hard_rows(spark, tmp_path):
    """Every stage on null, empty and very long texts, null and repeated ids, clashing columns, and on an empty table."""
    import corpus_pipeline

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(0, "x y z x y z x y z"), (None, None)], "item_id int, text string")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for texts in (HARD, []):
        now = frame(spark, texts)
        for name, stage in corpus_pipeline.STAGES:
            before = now.columns
            now = textkit.cut(stage(spark, now, str(tmp_path)))
            assert name == "sentencepiece" or now.columns == before
        left = {r.doc_id for r in now.collect()}
        assert left == (set() if not texts else {d for d in left if d is not None} | ({None} & left))
        if texts:  # empty texts are one text, whose largest id stays; the leaking pair goes, with all its rows
            assert 2 in left and 1 not in left and not left & {10, 11} and {6, 8, 9, 12, 13, 14} <= left and len(left & {4, 5}) == 1


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "sentencepiece"]
    now, kept = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = textkit.cut(stage(spark, now, SF))
        assert now.columns == docs.columns
        kept.append([(r.doc_id, r.text) for r in now.select("doc_id", "text").collect()])
    scores = {r.doc_id: r.predicted for r in toxicity.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    want = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if not scores[r.doc_id]]
    assert sorted(kept[0]) == sorted(want)
    last = {}
    for d, t in want:
        last[t.translate(brute.LOWER)] = max(d, last.get(t.translate(brute.LOWER), d))
    want = [(d, t) for d, t in want if d in last.values()]
    assert {d for d, _ in kept[1]} == {d for d, _ in want}
    assert sorted(kept[1]) == sorted(want)
    classes = brute.near_classes(want)
    want = [(d, t) for d, t in want if classes[d] == d]
    assert {d for d, _ in kept[2]} == {d for d, _ in want}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, _ in brute.leaks(want, items)}
    want = [(d, t) for d, t in want if d not in bad]
    assert {d for d, _ in kept[3]} == {d for d, _ in want}
    assert sorted(kept[3]) == sorted(want)
    assert corpus_pipeline.run(spark, SF).count() == len(want)


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 200)]
    got = {r.node: r.root for r in textkit.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)}
